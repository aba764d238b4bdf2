"""Language identification: the family first, then one-versus-one linear support vector machines within it.

Features are the hashed byte trigrams of the lower-cased whole text, counted and scaled to unit length. A family is told by
one machine for each against the rest, so that their number grows with the families and not with its square; within a family
there is a machine for each two languages. Each is fitted in a task of its own, on rows kept sparse: those of its languages,
of which the sample's size per language is a parameter (SAMPLE), and for a family also OTHERS rows of all languages. The
counts that set the sampling rate, and the predictions, cover all rows; every language is learnt.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.common import BROADCAST_KEYS, materialize, read_table, tidy

BITS = 13
#: About so many labelled rows of each language are sampled for fitting.
SAMPLE = 400
#: About so many rows, drawn from all languages of the sample, stand for the rest when a family is learnt.
OTHERS = 1_000
UNKNOWN = "und"
#: A document is rejected below this score (and without a language).
LEAST_SCORE = 0.2

# Language codes by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "gu", "pa", "ne"),
    "iranian": ("fa", "ku", "ps"),
    "semitic": ("ar", "he", "am", "mt"),
    "sinitic": ("zh", "yue"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    """The family of a language; one that isn't listed is a family of its own."""
    return FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], lang)


def trigrams(text: str, bits: int = BITS) -> np.ndarray:
    """Hashes of the byte trigrams of the lower-cased text between two spaces."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    code = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    return (code * np.uint32(2654435761)) >> np.uint32(32 - bits)


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and their counts, scaled to unit length."""
    counts = np.bincount(trigrams(text, bits))
    at = np.flatnonzero(counts)
    x = np.sqrt(counts[at].astype(np.float32))
    return at, x / np.linalg.norm(x)


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 10.0, epochs: int = 20, seed: int = 7, bits: int = BITS) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine (squared hinge) by dual coordinate descent; y is -1 or 1."""
    rng = np.random.default_rng(seed)
    # each side counts alike
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    alpha, w = np.zeros(len(y)), np.zeros((1 << bits) + 1, np.float32)
    rows = [(np.r_[at, 1 << bits], np.r_[x, np.float32(1)]) for at, x in rows]
    diagonal = np.array([float(x @ x) for _, x in rows]) + 0.5 / cost
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at, x = rows[i]
            gradient = y[i] * float(w[at] @ x) - 1 + alpha[i] * 0.5 / cost[i]
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                w[at] += np.float32((new - alpha[i]) * y[i]) * x
                alpha[i] = new
    return w


@dataclass
class Model:
    """within: languages by family; families and pairs: what each column of ``weights`` tells from the rest, or apart."""

    within: dict[str, list[str]] = field(default_factory=dict)
    families: list[str] = field(default_factory=list)
    pairs: list[tuple[str, str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(((1 << BITS) + 1, 0), np.float32))

    def __post_init__(self) -> None:
        self.columns: dict[str, list[int]] = {}
        for k, (family, _, _) in enumerate(self.pairs):
            self.columns.setdefault(family, []).append(len(self.families) + k)

    def family(self, margins: np.ndarray) -> tuple[str, float]:
        """The family with the highest margin, and how sure it is against the next."""
        if not self.families:
            return next(iter(self.within)), 1.0
        first = int(np.argmax(margins))
        second = float(np.max(np.delete(margins, first)))
        return self.families[first], 1 / (1 + float(np.exp(-2 * (float(margins[first]) - second))))

    def duel(self, family: str, margins: np.ndarray) -> tuple[str, float]:
        """The language of a family that wins most duels (then by summed margins), and how sure its closest one is."""
        names = self.within[family]
        if len(names) == 1:
            return names[0], 1.0
        votes, total, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
        for k, m in zip(self.columns[family], margins.tolist(), strict=True):
            _, a, b = self.pairs[k - len(self.families)]
            votes[a if m >= 0 else b] += 1
            for name, own in ((a, m), (b, -m)):
                total[name] += own
                least[name] = min(least[name], own)
        best = max(names, key=lambda n: (votes[n], total[n], n))
        return best, 1 / (1 + float(np.exp(-4 * least[best])))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.within or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        at, x = features(text)
        n = len(self.families)
        family, sure = self.family(x @ self.weights[at, :n] + self.weights[-1, :n])
        own = self.columns.get(family, [])
        lang, surer = self.duel(family, x @ self.weights[np.ix_(at, own)] + self.weights[-1, own])
        return lang, sure * surer


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


ROWS = "lang string, at binary, x binary"


def read_rows(at: Iterable[bytes], x: Iterable[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in zip(at, x, strict=True)]


def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """ROWS of about ``sample`` usable rows of each language, drawn by a hash of doc_id and text; of rows repeated in full one is drawn."""
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rates = materialize(usable.groupBy("lang").agg(F.least(F.lit(1.0), sample / F.count("*")).alias("rate")), "rates")
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_KEYS // 8 else rates
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 20)) / float(1 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang.as_py(), *features(text.as_py())) for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True) if text.as_py()]
            arrays = [pa.array([r[0] for r in found], pa.string())]
            arrays += [pa.array([r[k].astype(t).tobytes() for r in found], pa.binary()) for k, t in ((1, np.int32), (2, np.float32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "at", "x"])

    drawn = usable.withColumn("draw", draw).join(rates, "lang").filter("draw < rate").dropDuplicates(["doc_id", "lang", "text"])
    return materialize(drawn.select("lang", "text").mapInArrow(tidy(run), ROWS), "sample")


def fit(docs: DataFrame, sample: int = SAMPLE, others: int = OTHERS) -> Model:
    """Learn from text and non-null lang of rows that are not held out, of ``sample`` rows a language."""
    rows = sampled(docs, sample)
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    within: dict[str, list[str]] = {}
    for lang in sorted(counts):
        within.setdefault(family_of(lang), []).append(lang)
    families = sorted(within) if len(within) > 1 else []
    pairs = [(f, a, b) for f in sorted(within) for a, b in itertools.combinations(within[f], 2)]
    if not families and not pairs:
        return Model(within)
    order = F.xxhash64("at", "x")
    rest = rows.filter(F.pmod(order, F.lit(1 << 20)) < (1 << 20) * min(1.0, others / sum(counts.values()))).orderBy(order).limit(2 * others).collect()
    rest_rows, rest_family = read_rows([r.at for r in rest], [r.x for r in rest]), [family_of(r.lang) for r in rest]
    machines = [(k, lang, 1) for k, f in enumerate(families) for lang in within[f]]
    machines += [(len(families) + k, lang, sign) for k, (_, a, b) in enumerate(pairs) for lang, sign in ((a, 1), (b, -1))]
    machine = rows.sparkSession.createDataFrame(machines, "machine int, lang string, sign int")

    def learn(group: pa.Table) -> pa.Table:
        k = group.column("machine")[0].as_py()
        own = sorted(zip(group.column("sign").to_pylist(), group.column("at").to_pylist(), group.column("x").to_pylist(), strict=True))
        x, y = read_rows([r[1] for r in own], [r[2] for r in own]), [r[0] for r in own]
        if k < len(families):
            x += [r for r, f in zip(rest_rows, rest_family, strict=True) if f != families[k]]
            y += [-1] * (len(x) - len(y))
        return pa.table({"machine": pa.array([k], pa.int32()), "weights": pa.array([svm(x, np.array(y, np.float64)).tobytes()], pa.binary())})

    learnt = rows.join(machine, "lang").groupBy("machine").applyInArrow(learn, "machine int, weights binary").collect()  # a row a machine
    weights = np.zeros(((1 << BITS) + 1, len(families) + len(pairs)), np.float32)
    for r in learnt:
        weights[:, r.machine] = np.frombuffer(r.weights, np.float32)
    return Model(within, families, pairs, weights)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Predict from the text alone: doc_id, held_out, lang_pred, score.

    A null text, or one without a letter, is ``und`` with score zero. A null doc_id is not held out, and never learnt
    from. Repeated rows come back as often as they are there; an empty table gives an empty result.
    """
    names, shared = ["doc_id", "held_out", "lang_pred", "score"], docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column("text")]
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out, "text")
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without rows whose language isn't known or too unsure; all columns stay.

    Null and empty texts and those without a letter go, as they have no language; repeated rows are judged alike; a null
    lang or doc_id is only not learned from; an empty table, or one without any lang, gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column("text")]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their predicted language."""
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
