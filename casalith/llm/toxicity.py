"""Toxicity by a linear-chain conditional random field over tokens.

Labels are of documents, so tokens get theirs from the corpus: words and word beginnings that are far more frequent in documents
labelled toxic make a lexicon, and its tokens in those documents are the toxic ones. A chain over them learns what such tokens
and such neighbours weigh and how tags follow each other. Forward-backward marginals then give each document its score and the offending offsets.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let

_WORD = re.compile(r"\w+")
#: So many labels at most (12 bytes each) are broadcast to the texts; with more, texts are shuffled to their labels.
MOST_BROADCAST_ROWS = 1_000_000

def features(token: str) -> tuple[str, ...]:
    """A lower-cased token's features: itself, and its first 4 and 5 characters if it is longer."""
    return tuple([f"w:{token}"] + [f"{n}:{token[:n]}" for n in (4, 5) if len(token) > n])


def _contexts(text: Column) -> Column:
    """The (word, hash of the word before it) of a text."""

    def pairs(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.struct(w[i].alias("word"), F.xxhash64(F.when(i > 0, w[i - 1])).alias("before")))

    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    return let(words, lambda w: F.when(F.size(w) > 0, pairs(w)))


def lexicon(labelled: DataFrame, least: int = 5, least_odds: float = 4.0, least_evidence: float = 12.0) -> dict[str, float]:
    """Log-odds of features that toxic documents use in many contexts and others hardly ever, over all labelled rows.

    In toxic documents a feature counts once for each different word before it, so that the words of one text don't get in by
    being copied: at least `least` times, however many documents there are. Such features are then counted by documents of either
    label, and all stay whose log-odds are high and whose likelihood ratio against equal shares (G) is least_evidence or more.
    """
    labelled = labelled.select("text", "toxic")
    sizes = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1:
        return {}
    used = labelled.filter("toxic = 1").select(F.explode(_contexts(F.col("text"))).alias("c")).select("c.word", "c.before").distinct()
    starts = [F.when(F.length("word") > n, F.concat(F.lit(f"{n}:"), F.substring("word", 1, n))) for n in (4, 5)]
    each = used.select(F.explode(F.array(F.concat(F.lit("w:"), "word"), *starts)).alias("f"), "before").filter("f IS NOT NULL").distinct()
    often = each.groupBy("f").agg(F.count("*").alias("contexts")).filter(F.col("contexts") >= least).select("f")
    counts = labelled.mapInPandas(_counter, "f string, toxic int, n long").groupBy("f").agg(*[F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)).alias(c) for t, c in ((1, "a"), (0, "b"))])
    share = lambda c, n: F.log((F.col(c) + 0.5) / (n + 1))
    part = lambda c, n: F.when(F.col(c) > 0, 2 * F.col(c) * F.log(F.col(c) * (n1 + n0) / (n * (F.col("a") + F.col("b"))))).otherwise(0.0)
    # without clean documents no share differs, and the log-odds alone decide
    evidence = part("a", n1) + part("b", n0) if n0 else F.lit(least_evidence)
    sure = counts.withColumn("odds", share("a", n1) - share("b", n0)).filter((F.col("odds") >= least_odds) & (evidence >= least_evidence))
    top = sure.join(often, "f", "left_semi").orderBy(F.desc("odds"), "f")
    return {r["f"]: r["odds"] for r in top.select("f", "odds").collect()}


def _counter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents that have a feature, by feature and label: partial counts, given out whenever many features are held."""
    found: dict[int, Counter] = {0: Counter(), 1: Counter()}
    memo: dict[str, tuple[str, ...]] = {}

    def rows() -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"f": list(c.keys()), "toxic": t, "n": list(c.values())}) for t, c in found.items()])

    for b in batches:
        for text, toxic in zip(b["text"], b["toxic"], strict=True):
            own: set[str] = set()
            for t in set(_WORD.findall((text or "").lower())):
                fs = memo.get(t)
                if fs is None:
                    memo[t] = fs = features(t)
                own.update(fs)
            found[int(toxic)].update(own)
            if len(found[0]) + len(found[1]) > 500_000:
                yield rows()
                found[0].clear(), found[1].clear()
            if len(memo) > 200_000:
                memo.clear()
    if found[0] or found[1]:
        yield rows()


@dataclass
class Model:
    """Weights of features for the toxic tag, a bias, tag transitions (from, to), the calibration of document scores, and what it
    weighs that the token before, or the one after, has a feature.
    """

    weights: dict[str, float]
    bias: float
    moves: np.ndarray
    calibration: tuple[float, float, float]
    near: tuple[float, float] = (0.0, 0.0)

    def emission(self, token: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(token))


def _messages(x: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of two tags, one ratio each; x: exp of emissions, t: exp of moves."""
    n = x.shape[1]
    ahead, back = np.empty_like(x), np.ones_like(x)
    if n:
        ahead[:, 0] = x[:, 0]
    for i in range(1, n):
        r = ahead[:, i - 1]
        ahead[:, i] = x[:, i] * (r * t[1, 1] + t[0, 1]) / (r * t[1, 0] + t[0, 0])
    for i in range(n - 2, -1, -1):
        q = x[:, i + 1] * back[:, i + 1]
        back[:, i] = (t[1, 1] * q + t[1, 0]) / (t[0, 1] * q + t[0, 0])
    return ahead, back


def marginals(e: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(toxic) of each position; e: chains x positions of toxic-minus-clean scores."""
    ahead, back = _messages(np.exp(np.clip(e, -30, 30)), np.exp(moves))
    odds = ahead * back
    return odds / (1 + odds)


def _train(f: np.ndarray, y: np.ndarray, count: np.ndarray, n_features: int, rounds: int = 150, l2: float = 1e-3, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Weights (two of context and the bias last) and moves by gradient ascent (Adam) on the likelihood of tags, a block of stretches at a time.

    f: stretches x positions x features of the position (-1: none); y: tags; count: how often each stretch occurs.
    """
    share = count / count.sum()
    n = n_features + 2
    theta, m1, m2 = np.zeros(n + 5), np.zeros(n + 5), np.zeros(n + 5)
    theta[n] = -2.0
    at = np.where(f < 0, n + 4, f)
    for step in range(1, rounds + 1):
        w = theta.copy()
        w[n + 4] = 0
        moves = np.array([[0.0, w[n + 1]], [w[n + 2], w[n + 3]]])
        g = np.zeros_like(theta)
        for i in range(0, len(y), block):
            _gradient(g, at[i : i + block], y[i : i + block], share[i : i + block], w, moves, n)
        g[:-1] -= l2 * theta[:-1] * (1 / len(share))
        g[-1] = 0
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta += 0.3 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return theta[: n + 1], np.array([[0.0, theta[n + 1]], [theta[n + 2], theta[n + 3]]])


def _gradient(g: np.ndarray, at: np.ndarray, y: np.ndarray, share: np.ndarray, w: np.ndarray, moves: np.ndarray, n: int) -> None:
    """Adds the gradient of some stretches to g."""
    e = w[at].sum(axis=2) + w[n]
    x, t = np.exp(np.clip(e, -30, 30)), np.exp(moves)
    ahead, back = _messages(x, t)
    odds = ahead * back
    rest = (y - odds / (1 + odds)) * share[:, None]
    np.add.at(g, at.reshape(-1), np.repeat(rest.reshape(-1), at.shape[2]))
    g[n] += rest.sum()
    a, b = ahead[:, :-1], x[:, 1:] * back[:, 1:]
    z = t[0, 0] + t[0, 1] * b + t[1, 0] * a + t[1, 1] * a * b
    for j, (got, seen) in enumerate((((t[0, 1] * b) / z, (1 - y[:, :-1]) * y[:, 1:]), ((t[1, 0] * a) / z, y[:, :-1] * (1 - y[:, 1:])), ((t[1, 1] * a * b) / z, y[:, :-1] * y[:, 1:]))):
        g[n + 1 + j] += ((seen - got) * share[:, None]).sum()


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; of a null id: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _draw(rows: DataFrame, sample: int, chars: int) -> DataFrame:
    """The rows whose id hashes lowest: `sample` of them at most, and no more than hold so many code points; equal ids by text."""
    low = F.xxhash64(F.lit(5), "doc_id")
    some = rows.select(low.alias("h"), F.length("text").alias("n")).orderBy("h", "n").limit(sample)
    last = some.withColumn("all", F.sum("n").over(Window.orderBy("h", "n"))).filter(F.col("all") <= chars).agg(F.max("h")).first()[0]
    return rows.filter(F.lit(False) if last is None else low <= last).orderBy(low, "doc_id", "text").limit(sample).select("text", "toxic")


def _stretches(no: dict[str, int], stretch: int):
    """Over rows (text, toxic): how often each stretch of tokens occurs, as (f, y, n) with f and y bytes of int32."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chains: Counter = Counter()
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                tokens = _WORD.findall(text.lower())
                own = np.array([(*[no.get(x, -1) for x in features(t)], -1, -1)[:3] for t in tokens], np.int32).reshape(-1, 3)
                has = (own >= 0).any(axis=1)
                y = has & bool(toxic)
                near = np.full((len(own), 2), -1, np.int32)
                near[1:, 0][has[:-1]] = len(no)
                near[:-1, 1][has[1:]] = len(no) + 1
                pad = -len(own) % stretch
                f = np.concatenate([np.concatenate([own, near], axis=1), np.full((pad, 5), -1, np.int32)])
                y = np.concatenate([y, np.zeros(pad, bool)]).astype(np.int32)
                for i in range(0, len(f), stretch):
                    # most stretches are alike: none of their tokens has a feature
                    chains[(f[i : i + stretch].tobytes(), y[i : i + stretch].tobytes())] += 1
        yield pd.DataFrame({"f": [k[0] for k in chains], "y": [k[1] for k in chains], "n": list(chains.values())})

    return of


def _trainer(n_features: int):
    """Over all (f, y, n): one row of the trained weights and moves."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["f", "y"])
        if len(rows):
            y = np.stack([np.frombuffer(x, np.int32) for x in rows["y"]])
            f = np.stack([np.frombuffer(x, np.int32) for x in rows["f"]]).reshape(*y.shape, 5)
            theta, moves = _train(f, y, rows["n"].to_numpy(float), n_features)
            yield pd.DataFrame({"theta": [theta.tolist()], "moves": [moves.reshape(-1).tolist()]})

    return of


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, sample_chars: int = 20_000_000, stretch: int = 64) -> Model:
    """A model from the labelled rows that aren't held out.

    The lexicon counts all of them. The chain is fitted to the tokens of a sample: at most `sample` documents of either label and
    sample_chars code points, those whose id hashes lowest, whole, cut into stretches of 64 tokens. Stretches are counted where
    the texts are and the chain is trained in one task over the distinct ones; the driver gets the lexicon, the weights, and two
    numbers of each document of the sample for calibration. A document with several labels is toxic if one says so. Rows whose
    label is null, and null texts, say nothing. With no toxic row the model finds nothing toxic.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = F.broadcast(known) if known.count() <= MOST_BROADCAST_ROWS else known
    rows = cut(docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull()).join(known, "doc_id"))
    lex = lexicon(rows)
    no = {f: i for i, f in enumerate(lex)}
    nothing = Model({}, -10.0, np.zeros((2, 2)), (0.0, 0.0, -5.0))
    if not no:
        return nothing
    drawn = [_draw(rows.filter(F.col("toxic") == t), sample, sample_chars) for t in (0, 1)]
    drawn = cut(drawn[0].unionByName(drawn[1]).repartition(8, F.xxhash64("text")))
    counted = drawn.mapInPandas(_stretches(no, stretch), "f binary, y binary, n long").groupBy("f", "y").agg(F.sum("n").alias("n"))
    trained = counted.repartition(1).mapInPandas(_trainer(len(no)), "theta array<double>, moves array<double>").first()
    if trained is None:
        return nothing
    theta, moves = trained["theta"], np.array(trained["moves"]).reshape(2, 2)
    model = Model({f: theta[i] for f, i in no.items()}, theta[-1], moves, (0.0, 0.0, 0.0), (theta[-3], theta[-2]))
    return Model(model.weights, model.bias, moves, _calibrate(model, drawn), model.near)


def _calibrate(model: Model, drawn: DataFrame) -> tuple[float, float, float]:
    """Logistic weights of (log1p of expected toxic tokens, largest marginal) and an intercept, by Newton steps. drawn: (text, toxic)."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [s for at in range(0, len(b), 300) for s, _ in score_tokens(model, [_WORD.findall(t.lower()) for t in b["text"].iloc[at : at + 300]])]
            yield pd.DataFrame({"a": [s[0] for s in found], "b": [s[1] for s in found], "toxic": b["toxic"].to_numpy()})

    found = sorted(drawn.mapInPandas(sums, "a double, b double, toxic int").collect())
    x = np.array([[np.log1p(r[0]), r[1], 1.0] for r in found])
    y = np.array([r[2] for r in found], float)
    w = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * len(x) * 1e-2 * np.eye(3)
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-4 * len(x) * w)
    return tuple(float(v) for v in w)


class _Emissions(dict):
    """Emission scores of tokens, worked out when first asked for."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) > 100_000:
            self.clear()
        self[token] = value = self.model.emission(token)
        return value


class _Plain:
    """(expected, largest) of a chain of n tokens without any feature.

    Its forward messages depend on the distance from the start alone, its backward ones on the distance from the end, and both
    are constant from some hundred tokens on.
    """

    def __init__(self, model: Model, edge: int = 512):
        x = np.exp(np.clip(np.full((1, edge + 1), model.bias), -30, 30))
        x[0, -1] = np.exp(-30.0)
        ahead, back = _messages(x, np.exp(model.moves))
        self.edge, self.ahead, self.back = edge, ahead[0, :-1], back[0, :-1][::-1]

    def __call__(self, n: int) -> tuple[float, float]:
        k = min(n, self.edge)
        back = self.back[:k][::-1]
        odds = self.ahead[:k] * back if n <= self.edge else np.concatenate([self.ahead[: k // 2] * self.back[-1], self.ahead[-1] * back[k // 2 :]])
        p = odds / (1 + odds)
        return float(p.sum() + max(0, n - k) * p[k // 2]), float(p.max())


def score_tokens(model: Model, docs: list[list[str]], block: int = 512, cells: int = 2_000_000) -> list[tuple[tuple[float, float], list[int]]]:
    """Of each document: (expected toxic tokens, largest marginal), and the positions whose marginal is one half or more.

    Documents with a known feature go through the chain in blocks of about equal length and at most so many cells.
    """
    memo, plain = _Emissions(model), _Plain(model)
    out: list = [((0.0, 0.0), [])] * len(docs)
    todo: list[tuple[int, np.ndarray]] = []
    for i, tokens in enumerate(docs):
        if not tokens:
            continue
        e = np.fromiter(map(memo.__getitem__, tokens), float, len(tokens))
        has = e != model.bias
        if not has.any():
            out[i] = (plain(len(e)), [])
        else:
            e[1:] += model.near[0] * has[:-1]
            e[:-1] += model.near[1] * has[1:]
            todo.append((i, e))
    todo.sort(key=lambda x: len(x[1]))
    while todo:
        size = 1
        while size < min(block, len(todo)) and len(todo[-1][1]) * (size + 1) <= cells:
            size += 1
        some, todo = todo[-size:], todo[:-size]
        # past its end a chain is surely clean, by one position at least: its result doesn't depend on what shares the block
        x = np.full((size, len(some[-1][1]) + 1), -30.0)
        for row, (_, e) in enumerate(some):
            x[row, : len(e)] = e
        p = marginals(x, model.moves)
        for row, (i, e) in enumerate(some):
            own = p[row, : len(e)]
            out[i] = ((float(own.sum()), float(own.max())), np.flatnonzero(own >= 0.5).tolist())
    return out


def _score(model: Model, expected: float, largest: float) -> float:
    a, b, c = model.calibration
    return float(1 / (1 + np.exp(-np.clip(a * np.log1p(expected) + b * largest + c, -30, 30))))


def scores(text: Column, model: Model) -> Column:
    """struct(score double, offsets array<array<int>>): the score of each whole text, and [start, end) of toxic tokens in code points.

    Null and empty texts get the score of a text without any toxic token, and no offsets.
    """

    @F.pandas_udf("score double, offsets array<array<int>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = [t or "" for t in texts]
            scored, spans = [], []
            for at in range(0, len(texts), 2000):
                some = texts[at : at + 2000]
                for t, ((n, top), hits) in zip(some, score_tokens(model, [_WORD.findall(t.lower()) for t in some]), strict=True):
                    scored.append(_score(model, n, top))
                    where = [m.span() for m in _WORD.finditer(t)] if hits else []
                    spans.append([list(where[i]) for i in hits if i < len(where)])
            yield pd.DataFrame({"score": scored, "offsets": spans})

    return of(text)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, offsets and predicted (1 if score >= 0.5, else 0); columns of those names are replaced. Every row is kept."""
    out = docs.drop("score", "offsets", "predicted").withColumn("__s", scores(F.col("text"), model))
    kept = [F.col(f"`{c}`") for c in out.columns if c != "__s"]
    return out.select(*kept, "__s.score", "__s.offsets", (F.col("__s.score") >= 0.5).cast("int").alias("predicted"))


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    out = score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", "predicted", F.size("offsets").alias("n_offending"))
