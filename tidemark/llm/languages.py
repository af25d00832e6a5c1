"""Language identification: the family first, then the languages within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import freeze, spread

UNKNOWN = "und"

# Families of ISO 639-1 languages; any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo",
    "romance": "fr es it pt ro ca gl oc la co sc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu se",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi bn mr gu pa ur ne si or as",
    "iranian": "fa ku ps tg",
    "semitic": "ar he mt am ti",
    "dravidian": "ta te kn ml",
    "malayic": "id ms tl jv su",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def _letters() -> np.ndarray:
    """1 for code points of letters; what lies beyond the table counts as a letter."""
    return np.array([chr(c).isalpha() for c in range(0x3000)], bool)


_LETTER = _letters()
_SLICE = 250_000


def ngram_shares(texts: list[str], buckets: int) -> np.ndarray:
    """Per text the square roots of the shares of its hashed 1- to 3-grams of letters.

    Letters are lowered and every run of other characters is one gap.  Rows have
    length 1, or are zero for a text without letters.  Texts are counted in
    slices, so memory does not grow with the length of a text's n-grams.
    """
    counts = np.zeros(len(texts) * buckets, np.float64)
    # a gap before and after each text, so that neighbours do not matter
    padded = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in padded])[:-1]]).astype(np.int64)
    letter = np.where(codes < len(_LETTER), _LETTER[np.minimum(codes, len(_LETTER) - 1)], True)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts] = True
    ends = np.cumsum(np.add.reduceat(keep, starts, dtype=np.int64))
    symbols = np.where(letter, codes, 32)[keep]
    for at in range(0, len(symbols), _SLICE):
        first = max(0, at - 2)
        part = symbols[first : at + _SLICE].astype(np.uint64)
        places = np.arange(first, first + len(part))
        owner = np.searchsorted(ends, places, side="right")
        value = np.zeros(len(part), np.uint64)
        for n in range(min(3, len(part))):
            # the n-gram that ends at each place
            value[n:] = value[n - 1 : -1] * np.uint64(0x100000001B3) + part[n:] if n else part + np.uint64(1)
            grams, whose = value[n:], owner[n:]
            fresh = (places[n:] >= at) & (owner[: len(part) - n] == whose)
            if not n:
                fresh &= part != 32
            slot = (grams + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            slot = (slot ^ (slot >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(40)
            slot = (slot % np.uint64(buckets)).astype(np.int64) + whose * buckets
            counts += np.bincount(slot[fresh], minlength=len(counts))
    counts = counts.reshape(len(texts), buckets)
    has_letter = np.array([any(map(str.isalpha, t)) for t in texts], bool)
    counts[~has_letter] = 0
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, epochs: int = 60, take: np.ndarray | None = None) -> np.ndarray:
    """Weights and bias of a linear support vector machine (labels -1 and 1), by averaged subgradients.

    It learns from the rows ``take``, all if None; only a batch of them is copied.
    """
    take = np.arange(len(x)) if take is None else take
    rng = np.random.default_rng(0)
    w, mean, seen = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 0
    step = 0
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(len(take)), max(1, len(take) // 32)):
            step += 1
            rate = 1 / (penalty * (step + 1 / penalty))
            rows, signs = np.hstack([x[take[batch]], np.ones((len(batch), 1), np.float32)]), y[take[batch]]
            wrong = signs * (rows @ w) < 1
            w *= 1 - rate * penalty
            w += rate * (signs[wrong] @ rows[wrong]) / len(batch)
            if epoch >= epochs // 2:
                seen += 1
                mean += (w - mean) / seen
    return mean


def fit_duel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The machine between two classes (labels 1 and -1), which weigh the same whatever their sizes."""
    few, many = sorted([np.flatnonzero(y > 0), np.flatnonzero(y < 0)], key=len)
    take = np.concatenate([many, np.resize(few, len(many))])
    return fit_svm(x, y, take=take).astype(np.float32)


def _members(langs: list[str]) -> dict[str, list[str]]:
    families: dict[str, list[str]] = {}
    for lang in sorted(langs):
        families.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    return families


def duels(langs: list[str]) -> list[tuple[str | None, str, str]]:
    """All machines to fit: pairs of families (level None), and pairs of languages within each family."""
    members = _members(langs)
    return [(None, a, b) for a, b in combinations(sorted(members), 2)] + [
        (family, a, b) for family, own in members.items() for a, b in combinations(own, 2)
    ]


def _sides(machines: list[tuple[str | None, str, str]], langs: list[str]) -> list[tuple[str, int, int]]:
    """Each language with the duels it takes part in, and for which side."""
    members, out = _members(langs), []
    for number, (level, *classes) in enumerate(machines):
        for sign, name in zip((1, -1), classes, strict=True):
            out += [(lang, number, sign) for lang in ([name] if level else members[name])]
    return out


@dataclass
class Duel:
    """One-versus-one machines between classes; the class that wins most duels is chosen."""

    classes: list[str]
    weights: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner's number and how clearly it won its closest duel (0.5 to 1)."""
        n = len(self.classes)
        if n == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margin = np.zeros((len(x), n, n))
        for (i, j), w in self.weights.items():
            margin[:, i, j] = x @ w[:-1].astype(np.float32) + w[-1]
            margin[:, j, i] = -margin[:, i, j]
        wins = (margin > 0).sum(axis=2) + 1e-3 * np.tanh(margin.sum(axis=2))
        best = wins.argmax(axis=1)
        own = margin[np.arange(len(x)), best]
        own[np.arange(len(x)), best] = np.inf
        return best, np.clip(1 / (1 + np.exp(-2 * own.min(axis=1))), 0, 1)


@dataclass
class LanguageModel:
    buckets: int
    families: Duel
    within: dict[str, Duel]

    @classmethod
    def of(cls, buckets: int, langs: list[str], weights: dict[tuple[str | None, str, str], np.ndarray]) -> LanguageModel:
        """The model of the duels between ``langs``, as ``duels`` names them."""

        def among(level: str | None, classes: list[str]) -> Duel:
            return Duel(classes, {(i, j): weights[level, classes[i], classes[j]] for i, j in combinations(range(len(classes)), 2)})

        members = _members(langs)
        return cls(buckets, among(None, sorted(members)), {f: among(f, own) for f, own in members.items()})

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        x = ngram_shares(texts, self.buckets)
        langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        known = np.flatnonzero(x.any(axis=1))
        if len(known):
            chosen, sure = self.families.choose(x[known])
            for i, family in enumerate(self.families.classes):
                rows = known[chosen == i]
                if len(rows):
                    best, score = self.within[family].choose(x[rows])
                    langs[rows] = np.array(self.within[family].classes, object)[best]
                    scores[rows] = sure[chosen == i] * score
        return langs.tolist(), scores.tolist()


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Start and texts of runs of rows with a bounded number of texts and characters."""
    start, texts, size = 0, [], 0
    for i, text in enumerate(batch["text"]):
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if len(texts) == 64 or size > _SLICE:
            yield start, texts
            start, texts, size = i + 1, [], 0
    if texts:
        yield start, texts


def learn_languages(
    labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", per_language: int = 400, buckets: int = 8192, most_languages: int = 64
) -> LanguageModel | None:
    """A model from at most ``per_language`` texts of each language (None if nothing is labelled).

    The texts are those with the smallest hashes, equal texts once, so the choice
    does not depend on ids or order.  The ``most_languages`` languages with the most distinct texts are
    learned (by name among equals).  N-gram shares are made on the executors, and every duel between
    two classes is fitted in a task of its own; the driver gets the weights, one short vector a duel.
    Texts without letters and rows without a language are not learned from.
    """
    spark = labelled.sparkSession
    rows = labelled.select(labelled[text_col].cast("string").alias("text"), labelled[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}")))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    # distinct texts, for copies must not lower the share of those that pass; counted exactly
    distinct = hashed.groupBy("lang", "h").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["lang"]: r["n"] for r in distinct.orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not counts:
        return None
    # over four times as many as needed pass by hash; copies then fall together, and the smallest hashes stay
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, (4 * per_language + 64) / n))) for k, n in counts.items()])
    picked = hashed.where(F.shiftrightunsigned("h", 11) < share * float(2**53))
    single = picked.groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = F.row_number().over(_window())
    chosen = single.withColumn("nth", order).where(F.col("nth") <= per_language).select("lang", "text")
    machines = duels(list(counts))
    weights = {}
    if machines:
        # at most most_languages squared rows
        sides = F.broadcast(spark.createDataFrame(_sides(machines, list(counts)), "lang string, duel int, y int"))
        vectors = freeze(_vectors(chosen, buckets), "language-vectors")
        fitted = vectors.join(sides, "lang").groupBy("duel").applyInArrow(_fit_group, "duel int, w binary")
        weights = {machines[r["duel"]]: np.frombuffer(r["w"], np.float32) for r in fitted.collect()}
    return LanguageModel.of(buckets, list(counts), weights)


def _vectors(texts: DataFrame, buckets: int) -> DataFrame:
    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, some in _portions(batch):
                found = [v.astype(np.float16).tobytes() for v in ngram_shares(some, buckets)]
                yield pa.RecordBatch.from_arrays([batch["lang"].slice(start, len(some)), pa.array(found, pa.binary())], names=["lang", "x"])

    return texts.mapInArrow(shares, "lang string, x binary")


def _fit_group(group: pa.Table) -> pa.Table:
    """One duel: the vectors of two classes, bounded by ``per_language`` and the languages of two families."""
    langs, vectors = group["lang"].to_pylist(), group["x"].to_pylist()
    order = sorted(range(group.num_rows), key=lambda i: (langs[i], vectors[i]))
    x = np.empty((len(order), len(vectors[0]) // 2), np.float32)
    for place, i in enumerate(order):
        x[place] = np.frombuffer(vectors[i], np.float16)
    duel, y = group["duel"][0].as_py(), group["y"].to_numpy()[order].astype(np.float64)
    # the vectors in one form only while the machine is fitted
    del group, vectors
    return pa.Table.from_arrays([pa.array([duel], pa.int32()), pa.array([fit_duel(x, y).tobytes()], pa.binary())], names=["duel", "w"])


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("lang").orderBy("h")


def identify(docs: DataFrame, model: LanguageModel | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, in one pass and without a shuffle.

    Only the text is looked at, all of it.  Defined cases: null, empty and
    letterless texts are ``und`` with score 0, and so is everything if there is
    no model; rows are independent of each other, so repeated rows and null ids
    need no rule; columns of ``docs`` called ``lang_pred`` or ``lang_score`` are replaced.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    kept = docs.drop("lang_pred", "lang_score")
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            only = pa.RecordBatch.from_arrays([texts.cast(pa.string())], names=["text"])
            langs, scores = [], []
            for _, some in _portions(only):
                more = model.predict(some) if model else ([UNKNOWN] * len(some), [0.0] * len(some))
                langs += more[0]
                scores += more[1]
            names = [*batch.schema.names, "lang_pred", "lang_score"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    return kept.mapInArrow(run, schema)


def learnable(docs: DataFrame, id_col: str = "doc_id"):
    """True for the documents that may be learned from: two thirds of them, by the checksum of their id."""
    return F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % 3 != 1, F.lit(False))


def identify_languages(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with predictions, learned from its own labels outside the held-out third."""
    return identify(spread(docs), learn_languages(docs.where(learnable(docs)), **options))
