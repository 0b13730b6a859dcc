"""Quality scores by co-training of two views.

The text view sees what is written: shares of letters, symbols, capitals and digits, how often words repeat, how words
are built. The metadata view sees how the page is described and laid out: language, source, length, lines and their
lengths; it never sees a word, and the text view sees no length. Each view has a classifier. Over some rounds each
classifier labels the unlabelled documents of which it is most certain, and these pseudo-labels train the other one. Both
are then calibrated on labelled documents kept aside, and a last small model combines the calibrated views. Every document
is scored.

Both views of every document are measured once and written as 200 bytes. The pool is all documents without a label,
copies with the same views counted once: each round scores all of it where it lies. A histogram of the scores names the
bucket at which a round's number of pseudo-labels ends, and only the rows beyond it, about that number, reach the
driver. Fitting uses at most about ``labelled_rows`` labelled documents, drawn by the hash of their ids and views.

Defined results: a null text counts as empty, other nulls are values of their own; rows without a usable label are part
of the pool; without labels of both kinds every score is the share of good labels; an empty table gives an empty
result; ``score_quality`` ignores other columns, ``drop_low_quality`` carries them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import lean, materialise, text_of
from quillon.llm.labelled import with_labels
from quillon.llm.logistic import Logistic, fit, sigmoid
from quillon.llm.wordhash import constants, grouped, mix, texts_of, word_hashes


@dataclass(frozen=True)
class QualityOptions:
    labelled_rows: int = 20_000
    rounds: int = 4
    per_round: int = 300  # pseudo-labels that a view gives in a round: the method's step, as in its publication
    certain: float = 2.0  # logit beyond which a view may give one
    pseudo_weight: float = 0.3  # against a real label
    kept_aside: int = 4  # every so many labelled documents calibrate instead of training
    reject_below: float = 0.5


_KIND = np.zeros((6, 256))
_KIND[0, [*range(97, 123), *range(128, 256)]] = 1  # lower-case letters; letters beyond ASCII count as such
_KIND[1, list(range(65, 91))] = 1
_KIND[2, list(range(48, 58))] = 1
_KIND[3, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_KIND[4, 10] = 1
_KIND[5, [32, 9, 11, 12, 13]] = 1
_FINAL = np.zeros(256)
_FINAL[[ord(c) for c in ".!?"]] = 1
_CODES = np.argmax(_KIND, axis=0)
_CODES[_KIND.sum(axis=0) == 0] = 5

TEXT_FEATURES = 13
PAGE_HASHES = 16
PAGE_FEATURES = 7 + 2 * PAGE_HASHES


def text_features(text: bytes, words: np.ndarray) -> list[float]:
    raw = np.frombuffer(text, dtype=np.uint8)
    n = max(len(raw), 1)
    lower, upper, digits, marks, _, _ = np.bincount(_CODES[raw], minlength=6)[:6] / n
    solid = max(lower + upper + digits + marks, 1e-9)
    count = max(len(words), 1)
    values, times = np.unique(words, return_counts=True)
    again = float((words[1:] == words[:-1]).sum()) if len(words) > 1 else 0.0
    pairs = mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words
    marked = _CODES[raw] == 3
    runs = float((marked[1:] & marked[:-1]).sum()) if len(raw) > 1 else 0.0
    return [
        lower / solid,
        upper / solid,
        digits / solid,
        marks / solid,
        (marks / solid) ** 2,
        n / count,
        len(values) / count,
        float(times.max(initial=0)) / count,
        again / count,
        len(np.unique(pairs)) / max(len(pairs), 1),
        runs / n,
        _FINAL[raw].sum() / count,
        upper / (upper + lower + 1e-9),
    ]


def page_features(text: bytes, language: str | None, source: str | None, words: int) -> list[float]:
    lines = [len(x) for x in text.split(b"\n")]
    shape = [
        np.log1p(len(text)),
        np.log1p(len(lines)),
        np.log1p(max(lines)),
        float(np.log1p(np.mean(lines))),
        float(np.std(lines) / (1 + np.mean(lines))),
        sum(x == 0 for x in lines) / len(lines),
        np.log1p(words / len(lines)),
    ]
    hashed = np.zeros(2 * PAGE_HASHES)
    for i, value in enumerate((language, source)):
        name = np.frombuffer(("-" if value is None else f"={value}").encode(), dtype=np.uint8).astype(np.uint64)
        place = mix((name * constants(len(name), 29)).sum(dtype=np.uint64, keepdims=True))[0] % np.uint64(PAGE_HASHES)
        hashed[i * PAGE_HASHES + int(place)] = 1
    return [*shape, *hashed]


def both_views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Columns 0 to 2: text, lang, source."""
    texts, languages, sources = texts_of(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()
    seen, told = np.zeros((len(texts), TEXT_FEATURES)), np.zeros((len(texts), PAGE_FEATURES))
    for first, group in grouped(texts):
        words, at = word_hashes(group)
        for i, text in enumerate(group, first):
            own = words[at[i - first] : at[i - first + 1]]
            seen[i] = text_features(text, own)
            told[i] = page_features(text, languages[i], sources[i], len(own))
    return seen, told


@dataclass(frozen=True)
class Views:
    text: Logistic
    page: Logistic
    text_scale: Logistic  # of the text view's logit
    page_scale: Logistic
    joint: Logistic  # of both calibrated logits

    def scores(self, seen: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.text_scale.logits(self.text.logits(seen)[:, None])
        b = self.page_scale.logits(self.page.logits(told)[:, None])
        return sigmoid(a), sigmoid(b), self.joint.scores(np.column_stack((a, b)))


#: Gives, for both views' models and the keys that each view has given before, the pseudo-labels of a round:
#: (key, label, features) of either view.
Chooser = Callable[[list[Logistic], list[set[int]], float], list[list[tuple[int, int, np.ndarray]]]]


def co_train(features: np.ndarray, good: np.ndarray, choose: Chooser, options: QualityOptions) -> Views:
    """features: both views of the labelled rows, side by side; choose: from the pool."""
    aside = np.arange(len(good)) % options.kept_aside == 0
    truth = good[~aside].astype(np.float64)
    share = float(truth.mean()) if len(truth) else 0.5
    width = features.shape[1]
    given = [(np.empty((0, width)), np.empty(0)), (np.empty((0, width)), np.empty(0))]  # to each view
    keys: list[set[int]] = [set(), set()]  # that each view has given

    def train(v: int) -> Logistic:
        rows, labels = given[v]
        weight = np.concatenate((np.ones(len(truth)), np.full(len(rows), options.pseudo_weight)))
        x = np.concatenate((features[~aside][:, _SIDES[v]], rows[:, _SIDES[v]]))
        return fit(x, np.concatenate((truth, labels)), weight)

    for _ in range(options.rounds if len(np.unique(truth)) == 2 else 0):
        for v, chosen in enumerate(choose([train(0), train(1)], keys, share)):
            keys[v] |= {key for key, _, _ in chosen}
            rows, labels = given[1 - v]
            more = np.array([x for _, _, x in chosen], dtype=np.float64).reshape(-1, width)
            given[1 - v] = np.concatenate((rows, more)), np.append(labels, [float(y) for _, y, _ in chosen])
    text, page = train(0), train(1)
    kept = good[aside]
    a, b = (m.logits(features[aside][:, side])[:, None] for m, side in zip((text, page), _SIDES, strict=True))
    text_scale, page_scale = fit(a, kept), fit(b, kept)
    logits = np.column_stack((text_scale.logits(a), page_scale.logits(b)))
    joint = fit(logits, kept)
    # A view counts for what it says or not at all: a negative weight would turn its verdict round.
    if (against := joint.weights[:-1] < 0).any():
        joint = fit(np.where(against, 0.0, logits), kept)
    return Views(text, page, text_scale, page_scale, joint)


_SIDES = (slice(0, TEXT_FEATURES), slice(TEXT_FEATURES, TEXT_FEATURES + PAGE_FEATURES))


def _as_rows(column: pa.Array) -> np.ndarray:
    """The views of a binary column, one row for each."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype=np.float32).reshape(-1, TEXT_FEATURES + PAGE_FEATURES).astype(np.float64)


def views_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label (or null), features: both views of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.column_stack(both_views(batch)).astype(np.float32)
            packed = pa.array([x.tobytes() for x in both], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4), packed], names=["doc_id", "label", "features"])

    narrow = with_labels(docs.select("doc_id", "text", "lang", "source"), labels, "quality", "left").select(
        text_of().alias("text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("doc_id").cast("long"), "__label"
    )
    return lean(narrow).mapInArrow(measure, "doc_id long, label int, features binary")


#: Buckets of a logit's unit; a logit lies between -30 and 30.
_STEPS = 16


def choose_from(pool: DataFrame, options: QualityOptions) -> Chooser:
    """pool: key, features, each row once."""

    def choose(models: list[Logistic], keys: list[set[int]], share: float) -> list[list[tuple[int, int, np.ndarray]]]:
        gone = [np.array(sorted(k), dtype=np.int64) for k in keys]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, key = _as_rows(batch.column(1)), batch.column(0).to_numpy()
                for v in (0, 1):
                    logits = models[v].logits(rows[:, _SIDES[v]])
                    some = pa.array((np.abs(logits) > options.certain) & ~np.isin(key, gone[v]))
                    logit, part = pa.array(logits).filter(some), batch.filter(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), v, dtype=np.int32)), logit, part.column(0), part.column(1)], names=["view", "logit", "key", "features"]
                    )

        scored = pool.mapInArrow(score, "view int, logit double, key long, features binary")
        # Distance of a row's bucket from the most certain one, of its kind.
        fine = F.col("logit") > 0
        bucket = F.floor((30 - F.abs("logit")) * _STEPS).cast("int")
        marked = scored.select("view", fine.cast("int").alias("fine"), bucket.alias("bucket"), F.pmod("key", F.lit(1 << 20)).alias("at"), "key", "features")
        counts = marked.groupBy("view", "fine", "bucket").count().collect()  # at most 2 * 2 * 30 * 16 rows
        # Of each kind as many as its share among the labels.
        wanted = {0: round(options.per_round * (1 - share)), 1: round(options.per_round * share)}
        beyond = F.lit(False)
        for v, kind in ((v, kind) for v in (0, 1) for kind in (0, 1)):
            for last, below, n in [x for x in _running(counts, v, kind) if x[1] < wanted[kind]][-1:]:
                # The last bucket may hold very many: of its rows, in the order of their keys' remainders, a few more than are wanted.
                edge = min(1 << 20, int((1 << 20) * (2 * (wanted[kind] - below) + 64) / n))
                here = (F.col("view") == v) & (F.col("fine") == kind)
                beyond = beyond | (here & ((F.col("bucket") < last) | ((F.col("bucket") == last) & (F.col("at") < edge))))
        table = marked.filter(beyond).toArrow()
        rows = _as_rows(table["features"].combine_chunks()) if len(table) else np.empty((0, TEXT_FEATURES + PAGE_FEATURES))
        order = sorted(range(len(table)), key=list(zip(*(table[c].to_pylist() for c in ("bucket", "at", "key")), strict=True)).__getitem__)
        view, kinds, names = (table[c].to_pylist() for c in ("view", "fine", "key"))
        out: list[list[tuple[int, int, np.ndarray]]] = [[], []]
        for v, kind in ((v, kind) for v in (0, 1) for kind in (0, 1)):
            mine = [i for i in order if view[i] == v and kinds[i] == kind][: wanted[kind]]
            out[v] += [(names[i], kind, rows[i]) for i in mine]
        return out

    return choose


def _running(counts: list, view: int, fine: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, rows in the buckets before it, rows in it), from the most certain bucket on."""
    below = 0
    for bucket, n in sorted((r["bucket"], r["count"]) for r in counts if (r["view"], r["fine"]) == (view, fine)):
        yield bucket, below, n
        below += n


def learn(views: DataFrame, labels: DataFrame, options: QualityOptions) -> Views:
    """views: of all documents, as ``views_of`` gives them, written."""
    known = labels.filter(F.col("quality").isin(0, 1)).count()
    drawn = F.xxhash64(F.lit(31), "doc_id", "features")
    share = F.lit(int(1_000_000 * min(1.0, options.labelled_rows / max(known, 1))))
    table = (
        views.filter("label IS NOT NULL").distinct().select("label", "features", drawn.alias("drawn"))
        .filter(F.pmod("drawn", F.lit(1_000_000)) < share)
        .toArrow().sort_by([("drawn", "ascending"), ("features", "ascending")])
    )
    features = _as_rows(table["features"].combine_chunks()) if len(table) else np.empty((0, TEXT_FEATURES + PAGE_FEATURES))
    pool = views.filter("label IS NULL").select("features").distinct().select(F.xxhash64(F.lit(37), "features").alias("key"), "features")
    return co_train(features, table["label"].to_numpy(), choose_from(materialise(pool, "pool"), options), options)


def score_quality(docs: DataFrame, labels: DataFrame, options: QualityOptions = QualityOptions()) -> DataFrame:
    """doc_id, content_score, page_score, score, kept for every row of docs."""
    views = materialise(views_of(docs, labels), "views")
    shared = docs.sparkSession.sparkContext.broadcast(learn(views, labels, options))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _as_rows(batch.column(1))
            found = shared.value.scores(*(rows[:, side] for side in _SIDES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x) for x in found]], names=["doc_id", "content_score", "page_score", "score"]
            )

    return views.select("doc_id", "features").mapInArrow(
        score, "doc_id long, content_score double, page_score double, score double"
    ).withColumn("kept", F.col("score") >= options.reject_below)


def drop_low_quality(docs: DataFrame, labels: DataFrame, options: QualityOptions = QualityOptions()) -> DataFrame:
    """The rows of docs that the classifier keeps, with their own columns; each row is scored where it lies."""
    views = materialise(views_of(docs, labels), "views")
    shared = docs.sparkSession.sparkContext.broadcast(learn(views, labels, options))
    limit, at = options.reject_below, [docs.columns.index(c) for c in ("text", "lang", "source")]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [batch.column(i).cast(pa.string()) for i in at]
            both = (x.astype(np.float32).astype(np.float64) for x in both_views(pa.RecordBatch.from_arrays(told, names=list("abc"))))
            yield batch.filter(pa.array(shared.value.scores(*both)[2] >= limit))

    return lean(docs).mapInArrow(choose, docs.schema)
