"""Hierarchical language identification.

A text's features are the shares of its hashed byte n-grams (1 to 4 bytes of
the lower-cased text). One-versus-rest linear support vector machines choose
the language family; within it, one-versus-one machines vote on each pair of
languages. The machines are fitted on a bounded sample of labelled rows; every
whole text is then scored by sums of weights over its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B

#: Labelled rows of each language that the fit takes at most (those with the least hash of doc_id).
SAMPLE = 160
#: Labelled rows that the fit takes at most in all (languages then share them), and languages (the most frequent labels).
ROWS, LANGUAGES = 4000, 200
#: Hashed features.
BITS = 13
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
#: Orders that tell a language's text from junk, and labelled rows set aside from which a level for that is taken.
FAMILIAR, LEAST_ROWS = (3, 4), 8
#: Standard errors by which a text must be below the level.
SURE = 3.0
PREDICTIONS = "doc_id long, lang_pred string, score double, family string"

# Families of common languages by ISO 639-1 code. A language that
# stands in none makes a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "mk", "bg"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "cy", "gd", "br"),
    "indic": ("hi", "bn", "mr", "ne", "gu", "pa", "ur", "sa"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "turkic": ("tr", "az", "kk", "uz", "tk", "ky", "tt"),
    "semitic": ("ar", "he", "am", "mt"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "sinitic": ("zh", "yue", "wuu"),
    "austronesian": ("id", "ms", "tl", "jv", "su", "mg"),
}


def family_of(lang: str) -> str:
    return next((k for k, v in FAMILIES.items() if lang in v), lang)


def features(col: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the feature number at every byte position (of the n-gram that starts there, -1 beyond the row), and the row offsets."""
    data, offsets = B.buffer(pc.utf8_lower(pc.fill_null(col, "")))
    out, code = [], np.zeros(len(data), np.uint32)
    end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(len(data))
    for n in ORDERS:
        shifted = np.zeros(len(data), np.uint32)
        if len(data) >= n:
            shifted[: len(data) - n + 1] = data[n - 1 :]
        code = code * np.uint32(257) + shifted + np.uint32(1)
        f = ((code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - BITS)).astype(np.int32)
        f[at + n > end] = -1
        out.append(f)
    return out, offsets


def has_letter(col: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(pc.fill_null(col, ""), r"\pL").to_numpy(zero_copy_only=False)


@dataclass
class LinearSVM:
    weights: np.ndarray
    bias: float


def fit_svm(x: np.ndarray, gram: np.ndarray, y: np.ndarray, c: float = 4.0, rounds: int = 40, seed: int = 7) -> LinearSVM:
    """A squared-hinge linear machine by dual coordinate descent over the rows' inner products; y is +1 or -1."""
    n = len(y)
    alpha, decision, b = np.zeros(n), np.zeros(n), 0.0
    diagonal = gram.diagonal() + 1 + 1 / (2 * c)
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(n):
            g = y[i] * (decision[i] + b) - 1 + alpha[i] / (2 * c)
            new = max(alpha[i] - g / diagonal[i], 0.0)
            d = (new - alpha[i]) * y[i]
            if d:
                decision += d * gram[i]
                b += d
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return LinearSVM((alpha * y).astype(np.float32) @ x, float(b))


@dataclass
class Model:
    """The machines; ``scale`` weighs features (they are multiplied into the machines' weights)."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    machines: list[tuple[str, str, str, LinearSVM]] = field(default_factory=list)  # (family or "", one, other or "", machine)
    profile: np.ndarray | None = None  # log of each feature's share in labelled text over an even share
    level: float = 0.0  # mean of it below which a text is junk
    spread: float = 0.0  # its standard deviation from n-gram to n-gram

    def strange(self, col: pa.Array) -> np.ndarray:
        """Whether a row's n-grams are surely not those of any labelled language; never without a profile."""
        n = len(col)
        if self.profile is None:
            return np.zeros(n, bool)
        orders, offsets = features(col)
        filled = np.flatnonzero(np.diff(offsets) > 0)
        total, seen = np.zeros(n), np.zeros(n)
        for order in FAMILIAR:
            k = ORDERS.index(order)
            ok = orders[k] >= 0
            if len(filled):
                total[filled] += np.add.reduceat(np.where(ok, self.profile[(k << BITS) + np.where(ok, orders[k], 0)], 0), offsets[filled], dtype=np.float64)
                seen[filled] += np.add.reduceat(ok, offsets[filled], dtype=np.int64)
        return total + SURE * self.spread * np.sqrt(seen) < self.level * seen

    def _margins(self, machines: list[int], orders: list[np.ndarray], offsets: np.ndarray) -> np.ndarray:
        """Rows x machines."""
        n = len(offsets) - 1
        out = np.zeros((n, len(machines)))
        filled = np.flatnonzero(np.diff(offsets) > 0)
        for k, f in enumerate(orders):
            if not len(filled) or not machines:
                break
            ok = f >= 0
            g = np.where(ok, f, 0)
            seen = np.maximum(np.add.reduceat(ok, offsets[filled], dtype=np.int64), 1)
            for j, m in enumerate(machines):
                w = self.machines[m][3].weights[k << BITS : (k + 1) << BITS]
                out[filled, j] += np.add.reduceat(np.where(ok, w[g], 0), offsets[filled], dtype=np.float64) / seen
        return out + np.array([self.machines[m][3].bias for m in machines])

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray, list[str]]:
        """Language, score in 0..1 and family of each row: all rows go through the families' machines, and then only through those of their family."""
        n = len(col)
        if not self.families:
            return [UNKNOWN] * n, np.zeros(n), [UNKNOWN] * n
        orders, offsets = features(col)
        sure = lambda margins: 1 / (1 + np.exp(-np.clip(2.5 * margins, -30, 30)))
        first = [m for m, (family, *_) in enumerate(self.machines) if not family]
        fam = np.ones((n, len(self.families)))
        if first:
            fam[:, [self.families.index(self.machines[m][1]) for m in first]] = sure(self._margins(first, orders, offsets))
        fam /= np.maximum(fam.sum(1, keepdims=True), 1e-12)
        best = fam.argmax(1)
        letters = has_letter(col)
        best[~letters] = -1
        langs, families, scores = np.full(n, UNKNOWN, object), np.full(n, UNKNOWN, object), np.zeros(n)
        size = np.diff(offsets)
        for k, family in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            if not len(rows):
                continue
            names = self.languages[family]
            machines = [m for m, (f, *_) in enumerate(self.machines) if f == family]
            vote = np.zeros((len(rows), len(names)))
            if machines:
                inside = np.repeat(best == k, size)
                part = sure(self._margins(machines, [f[inside] for f in orders], np.r_[0, np.cumsum(size[rows])]))
                for j, m in enumerate(machines):
                    vote[:, names.index(self.machines[m][1])] += part[:, j]
                    vote[:, names.index(self.machines[m][2])] += 1 - part[:, j]
            top = vote.argmax(1)
            langs[rows], families[rows] = np.array(names, object)[top], family
            share = vote[np.arange(len(rows)), top] * len(names) / 2 / len(machines) if machines else 1.0
            scores[rows] = fam[rows, k] * share
        return langs.tolist(), np.clip(scores, 0, 1), families.tolist()


def _profile(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray | None, float, float]:
    """Profile, level and spread of :class:`Model`, from the features' shares and the languages of labelled rows.

    Every fourth row of a language is held out. The level is halfway between
    the least held-out row and what features drawn evenly have; there is none
    without enough rows or if the two don't stand apart.
    """
    rank = np.arange(len(y)) - np.searchsorted(y, y)  # y is sorted
    out = rank % 4 == 3
    if out.sum() < LEAST_ROWS:
        return None, 0.0, 0.0
    size = 1 << BITS
    profile = np.zeros(x.shape[1], np.float32)
    for order in FAMILIAR:
        part = slice(ORDERS.index(order) * size, (ORDERS.index(order) + 1) * size)
        mean = np.mean([x[(y == k) & ~out][:, part].mean(0) for k in np.unique(y)], 0)
        profile[part] = np.log((mean * size + 0.1) / 1.1)
    on = np.concatenate([np.arange(ORDERS.index(o) * size, (ORDERS.index(o) + 1) * size) for o in FAMILIAR])
    filled = out & (x[:, on].sum(1) > len(FAMILIAR) - 0.5)
    if not filled.any():
        return None, 0.0, 0.0
    held = x[filled][:, on] @ profile[on] / len(FAMILIAR)
    least, even = float(held.min()), float(profile[on].mean())
    spread = float(profile[on].std())
    return (profile, (least + even) / 2, spread) if least > even else (None, 0.0, 0.0)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows of each language of ``labelled`` (doc_id, text, lang), chosen by the hash of doc_id, and ROWS in all.

    Labels beyond the LANGUAGES most frequent are left out. Rows without lang or without a letter are left out. The n-gram counts of
    the sample are made on the executors; sample * languages of them come to
    the driver.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    labels = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["n"] for r in labels.collect()}
    if not counts:
        return Model()
    sample = max(1, min(sample, ROWS // len(counts)))
    # A hash bound a little above the share that is wanted, then the exact number in hash order.
    share = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.3 * sample / n + 20.0 / n))))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = rows.withColumn("h", h).filter(F.col("h") < F.try_element_at(share, F.col("lang")) * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in B.slices(batch.column(2)):
                orders, offsets = features(batch.column(2).slice(a, b - a))
                index, value = [], []
                for x, y in zip(offsets[:-1], offsets[1:]):
                    dense = np.concatenate([np.bincount(f[x:y][f[x:y] >= 0], minlength=1 << BITS) / max(1, (f[x:y] >= 0).sum()) for f in orders])
                    at = np.flatnonzero(dense)
                    index.append(at.astype("<i4").tobytes())
                    value.append(dense[at].astype("<f4").tobytes())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(index, pa.binary()), pa.array(value, pa.binary())], names=["h", "lang", "i", "v"])

    held: dict[str, list] = {}
    found = chosen.select("h", "lang", "text").mapInArrow(count, "h long, lang string, i binary, v binary")
    for r in sorted(found.collect(), key=lambda r: (r["lang"], r["h"])):
        if len(held.setdefault(r["lang"], [])) < sample:
            held[r["lang"]].append((np.frombuffer(r["i"], "<i4"), np.frombuffer(r["v"], "<f4")))
    langs = sorted(held)
    y = np.array([k for k, lang in enumerate(langs) for _ in held[lang]])
    x = np.zeros((len(y), len(ORDERS) << BITS), np.float32)
    for row, (i, v) in enumerate(r for lang in langs for r in held[lang]):
        x[row, i] = v
    profile = _profile(x, y)
    used = np.flatnonzero(np.count_nonzero(x, axis=0) > 1)
    scale = np.zeros(x.shape[1], np.float32)
    scale[used] = 1 / np.maximum(np.sqrt(np.einsum("ij,ij->j", x, x)[used] / len(x)), 1e-3)
    x = x[:, used]
    x *= scale[used]
    norm = np.float32(np.sqrt(np.median(np.einsum("ij,ij->i", x, x))) or 1.0)
    x /= norm
    gram = (x @ x.T).astype(np.float64)

    def machine(rows: np.ndarray, positive: np.ndarray) -> LinearSVM:
        svm = fit_svm(x[rows], gram[np.ix_(rows, rows)], np.where(positive, 1.0, -1.0))
        full = np.zeros(len(scale), np.float32)
        full[used] = svm.weights * scale[used] / norm
        return LinearSVM(full, svm.bias)

    families: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        families.setdefault(family_of(lang), []).append(k)
    model = Model(sorted(families), {f: [langs[k] for k in v] for f, v in families.items()}, [], *profile)
    everything = np.arange(len(y))
    if len(families) > 1:
        for f in model.families:
            model.machines.append(("", f, "", machine(everything, np.isin(y, families[f]))))
    for f, members in families.items():
        for a, one in enumerate(members):
            for other in members[a + 1 :]:
                rows = np.flatnonzero((y == one) | (y == other))
                model.machines.append((f, langs[one], langs[other], machine(rows, y[rows] == one)))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and family of every row; ``und`` with score 0 for a text that is null or has no letter."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for a, b in B.slices(batch.column(1)):
                langs, scores, families = model.predict(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(langs, pa.string()), pa.array(scores), pa.array(families, pa.string())], names=["doc_id", "lang_pred", "score", "family"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PREDICTIONS)


def held_out(folds: int = 5):
    """Whether crc32 of the doc_id as text leaves no remainder; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, predict all rows."""
    model = fit(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "family")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold no letter or whose n-grams are those of no labelled language, and with the language found in ``lang``; all columns stay.

    The score is a share among the languages and can't tell junk; what decides
    is how familiar a text is by itself (:meth:`Model.strange`). The model is
    fitted on the labelled rows of ``docs``; with too few of them, nothing can
    be told and only rows without a letter go.
    """
    model = fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for a, b in B.slices(batch.column(at)):
                part = batch.slice(a, b - a)
                part = part.filter(pa.array(has_letter(part.column(at)) & ~model.strange(part.column(at))))
                if model.families and part.num_rows:  # without labels there is nothing to tell languages by
                    part = part.set_column(lang, batch.schema.field(lang), pa.array(model.predict(part.column(at))[0], batch.schema.field(lang).type))
                yield part

    return docs.mapInArrow(run, docs.schema)
