"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is the multiset of its five-word shingles (a shorter text with words is
one shingle), and similarity is the probability Jaccard of the counts.
ProbMinHash: every shingle is a Poisson process whose rate is its count; an
arrival lands in a random register and keeps it if it is the earliest; a
process ends once its time is past the latest register of its text, so a
text costs about its length plus ``m log m`` arrivals.  Registers are banded
(``BANDS`` of ``ROWS``): a pair at 0.8 shares a band with probability
1 - (1 - 0.8**8)**48 > 0.9998, a pair at 0.5 with 0.17.

Texts with the same words are one node from the start.  A band shared by
several nodes is a bucket.  Star rounds come first: a few bands, then all of
them; every bucket compares one pivot of its largest class with its members of
other classes by the exact similarity of their texts, and classes are joined in
full between rounds.  A last round takes what is left: all pairs of different
classes in a bucket, at least one of them outside its largest class, each pair
in the first band it shares.  Its texts get ``SKETCH`` registers anew, of which
two bits each are kept.  A pair is compared if its sketches differ in no more
registers than those of a pair at the limit do by five standard deviations, so
from about 0.75; a pair at 0.8 fails that with probability below 1e-5.  So every
pair that shares a band is in one class, compared, or apart by its sketch.  A
bucket of copies costs its size; a bucket of c classes that stay apart costs its
size times the members outside its largest class in sketch tests, and text
comparisons only for near pairs.

A null text, and a text without words, is alone unless an equal text exists
(nulls are equal if their doc_id is).  Repeated rows share a class.  The class
id is the smallest doc_id of the class (null if all are).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches, stored
from skein.llm.components import connected
from skein.llm.textbytes import find_words, mix, shingles, text_bytes
from skein.session import spread

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 48, 8
#: Bands of the first star round, and star rounds before the last round.
FIRST_BANDS, STAR_ROUNDS = 4, 4
#: Registers of a sketch in the last round; the first ``GLANCE`` of them are looked at before the others.
SKETCH, GLANCE = 2048, 384
#: Bytes of text in a batch that gets sketches, each of which needs several times its registers of memory.
SKETCH_BATCH = 1 << 20
#: Standard deviations by which sketches of a pair at the limit may differ beyond their mean.
SKETCH_SLACK = 5.0


def weighted_shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles of each row, by row then hash."""
    row, h = shingles(find_words(*text_bytes(texts)), size)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    if not len(row):
        return row, h, np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]))
    return row[heads], h[heads], np.diff(np.concatenate([heads, [len(row)]]))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def prob_minhash(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """Register contents (rows x m): the hash of the earliest arrival; rows without shingles stay 0."""
    times = np.full(rows * m, np.inf)
    owner = np.zeros(rows * m, np.uint64)
    at, alive, clock = np.zeros(len(h)), np.arange(len(h)), 0
    while len(alive):
        clock += 1
        draw = mix(h[alive] + np.uint64(clock * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        at[alive] += -np.log(_uniform(draw)) / weight[alive]
        slot = row[alive] * m + (mix(draw ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(m)).astype(np.int64)
        early = at[alive] < times[slot]
        spot, who = slot[early], alive[early]
        np.minimum.at(times, spot, at[who])
        won = times[spot] == at[who]
        owner[spot[won]] = h[who[won]]
        present = np.unique(row[alive])
        limit = np.zeros(rows)
        limit[present] = times.reshape(rows, m)[present].max(axis=1)
        alive = alive[at[alive] < limit[row[alive]]]
    return owner.reshape(rows, m)


def _sketch(registers: np.ndarray) -> np.ndarray:
    """Two bits of each register as signed words (rows x 2 ceil(m / 64)): all first bits, then all second bits."""
    n, m = registers.shape
    place = mix(np.arange(1, m + 1, dtype=np.uint64))
    mixed = mix(registers ^ place[None, :])
    bits = np.zeros((n, 2, -(-m // 64) * 64), np.uint8)
    bits[:, 0, :m] = mixed >> np.uint64(63)
    bits[:, 1, :m] = mixed >> np.uint64(62) & np.uint64(1)
    return np.packbits(bits.reshape(n, -1), axis=1).view(np.int64)


def sketch_limit(similarity: float, m: int) -> int:
    """Registers in whose two bits the sketches of a pair at ``similarity`` or above may differ."""
    p = (1.0 - similarity) * 3 / 4
    return int(np.ceil(m * p + SKETCH_SLACK * np.sqrt(m * p * (1 - p))))


def _near(a: str, b: str, similarity: float) -> Column:
    """Whether two sketches leave it open that a pair is at ``similarity`` or above."""
    words = SKETCH // 64

    def unlike(i: Column) -> Column:
        return F.get(a, i).bitwiseXOR(F.get(b, i))

    def differing(i: Column) -> Column:
        return F.bit_count(unlike(i).bitwiseOR(unlike(i + words)))

    glance = [differing(F.lit(i)) for i in range(GLANCE // 64)]
    # One expression of all words would be more code than the JVM compiles.
    whole = F.aggregate(F.sequence(F.lit(0), F.lit(words - 1)), F.lit(0), lambda n, i: n + differing(i))
    return (sum(glance[1:], glance[0]) <= sketch_limit(similarity, GLANCE)) & (whole <= sketch_limit(similarity, SKETCH))


def _sketched(texts: DataFrame) -> DataFrame:
    """(key, sketch) of (key, text) rows, dealt out anew: a few texts cost as much as many elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sketch = _sketch(prob_minhash(*weighted_shingles(batch.column("text")), n, SKETCH))
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * sketch.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.ListArray.from_arrays(ends, pa.array(sketch.ravel()))], ["key", "sketch"]
            )

    dealt = spread(texts.select("key", "text"), "key")
    return map_batches(dealt, run, "key binary, sketch array<bigint>", SKETCH_BATCH)


def _text_keys(texts: pa.Array, ids: list) -> list[bytes]:
    """128-bit key of each row's word sequence; of the text itself where it has no words."""
    data, offsets = text_bytes(texts)
    words = find_words(data, offsets)
    # Word bytes, and the byte behind each word turned into a blank.
    marks = np.zeros(len(data) + 2, np.int64)
    marks[words.starts] += 1
    marks[words.ends] -= 1
    inside = np.cumsum(marks)[:-1] > 0
    pick = inside.copy()
    pick[words.ends] = True
    spelled = np.append(words.lower, np.uint8(32))
    spelled[~inside] = 32
    out = []
    for i, is_null in enumerate(texts.is_null().to_pylist()):
        s, e = int(offsets[i]), int(offsets[i + 1])
        if words.first[i] == words.first[i + 1]:
            plain = f"null {ids[i]}".encode() if is_null else b"raw " + data[s:e].tobytes()
        else:
            plain = b"words " + spelled[s:e][pick[s:e]].tobytes().strip(b" ")
        out.append(hashlib.blake2b(plain, digest_size=16).digest())
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """doc_id, th (a plain hash of the text), key of the word sequence, band keys."""
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = batch.column("text"), batch.num_rows
            row, h, count = weighted_shingles(texts)
            registers = prob_minhash(row, h, count, n, bands * rows).reshape(n, bands, rows)
            key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xA24BAED4963EE407)
            key = np.repeat(key, n, axis=0)
            for j in range(rows):
                key = mix(key ^ registers[:, :, j]) + np.uint64(j)
            has = np.bincount(row, minlength=n) > 0
            lists = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
            flat = pa.array(key[has].ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("th"),
                    pa.array(_text_keys(texts, batch.column("doc_id").to_pylist()), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(lists), flat),
                ],
                ["doc_id", "th", "key", "bands"],
            )

    id_type = dict(narrow.dtypes)["doc_id"]
    return map_batches(narrow, run, f"doc_id {id_type}, th bigint, key binary, bands array<bigint>")


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets given as sorted hashes and weights."""
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    w, v = wa[ia].astype(float), wb[ib].astype(float)
    # sum_j max(w_j / w_i, v_j / v_i): the first term wins where w_j / v_j >= w_i / v_i.
    ratio = w / v
    order = np.argsort(-ratio, kind="stable")
    w, v, ratio = w[order], v[order], ratio[order]
    upto = np.cumsum(w)[np.searchsorted(-ratio, -ratio, "right") - 1] + (wa.sum() - w.sum())
    beyond = wb.sum() - np.cumsum(v)[np.searchsorted(-ratio, -ratio, "right") - 1]
    return float((1.0 / (upto / w + beyond / v)).sum())


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are at least ``similarity`` alike."""
    joined = (
        pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("ta", "tb"):
                column = batch.column(name).dictionary_encode()
                row, h, count = weighted_shingles(column.dictionary)
                cut = np.searchsorted(row, np.arange(len(column.dictionary) + 1))
                sides.append((h, count, cut, column.indices.to_numpy(zero_copy_only=False)))
            (ha, wa, ca, ia), (hb, wb, cb, ib) = sides
            alike = [
                probability_jaccard(
                    ha[ca[x] : ca[x + 1]], wa[ca[x] : ca[x + 1]], hb[cb[y] : cb[y + 1]], wb[cb[y] : cb[y + 1]]
                )
                for x, y in zip(ia.tolist(), ib.tolist(), strict=True)
            ]
            mask = pa.array(np.array(alike) >= similarity - 1e-12)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"]
            )

    return map_batches(joined, run, "a binary, b binary")


def _mixed(members: DataFrame, labels: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """Members (band, key, label) of buckets with several classes, and (band, top, head): a bucket's largest
    class and one member of it, another in every step."""
    named = members.join(labels.withColumnRenamed("node", "key"), "key", "left").select(
        "band", "key", F.coalesce("label", "key").alias("label")
    )
    sizes = named.groupBy("band", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("key", F.xxhash64("key", F.lit(step))).alias("head")
    )
    tops = sizes.groupBy("band").agg(
        F.max_by(F.struct("label", "head"), F.struct("n", F.xxhash64("label", F.lit(step)))).alias("t"),
        F.count(F.lit(1)).alias("classes"),
    )
    tops = stored(
        tops.filter("classes > 1").select("band", F.col("t.label").alias("top"), F.col("t.head").alias("head")), "dedup"
    )
    return stored(named.join(tops.select("band"), "band"), "dedup"), tops


def _apart(others: DataFrame, members: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(x, y): pairs of a bucket in different classes, x outside its largest, whose sketches are near.

    ``nodes`` has the bands of each key.  A pair comes once, from the first band it shares: that is a bucket
    of several classes too, so it is among ``members``.
    """
    asked = members.select("key").distinct()
    sketches = stored(_sketched(texts.join(asked, "key")), "dedup").join(nodes.select("key", "bands"), "key")
    left = others.join(sketches, "key").select(
        "band",
        F.col("key").alias("x"),
        F.col("label").alias("lx"),
        F.col("top"),
        F.col("sketch").alias("sx"),
        F.col("bands").alias("bx"),
    )
    right = members.join(sketches, "key").select(
        F.col("band").alias("band_y"),
        F.col("key").alias("y"),
        F.col("label").alias("ly"),
        F.col("sketch").alias("sy"),
        F.col("bands").alias("by"),
    )
    first = F.array_position(F.zip_with("bx", "by", lambda p, q: p == q), True)
    near = (
        (F.col("band") == F.col("band_y"))
        & (F.col("lx") != F.col("ly"))
        & ((F.col("ly") == F.col("top")) | (F.col("x") < F.col("y")))
        & _near("sx", "sy", similarity)
        & (F.get("bx", (first - 1).cast("int")) == F.col("band"))
    )
    return left.join(right, near).select("x", "y")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after ``links``: links between classes are joined first, then carried to the members."""
    now = links
    for side in ("a", "b"):
        of = labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
        now = now.join(of, side, "left").withColumn(f"l{side}", F.coalesce(f"l{side}", side))
    merged = connected(now.select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a != b").distinct())
    after = merged.select(F.col("node").alias("label"), F.col("label").alias("joined"))
    moved = labels.join(after, "label", "left").select("node", F.coalesce("joined", "label").alias("label"))
    new = merged.join(labels.select("node"), "node", "left_anti")
    return stored(moved.union(new), "dedup")


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per input row: doc_id, th, key, class_id, and n_class, the rows of its class."""
    spark = docs.sparkSession
    signed = stored(signatures(docs, id_col, text_col, bands, rows), "dedup")
    nodes = signed.groupBy("key").agg(
        F.min_by("bands", "th").alias("bands"),
        F.min(F.struct("doc_id", "th")).alias("who"),
    )
    nodes = stored(nodes, "dedup")
    cells = nodes.select("key", F.posexplode("bands").alias("at", "band"))
    shared = cells.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    members = stored(cells.join(shared, "band").select("band", "at", "key"), "dedup")
    wanted = members.select("key").distinct().join(nodes, "key").select("key", "who.*")
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th")
    )
    same = (source["th"] == wanted["th"]) & source["doc_id"].eqNullSafe(wanted["doc_id"])
    texts = stored(source.join(wanted, same).select("key", "text").dropDuplicates(["key"]), "dedup")

    tested = spark.createDataFrame([], "a binary, b binary")
    labels = spark.createDataFrame([], "node binary, label binary")
    for step in range(STAR_ROUNDS + 1):
        open_, tops = _mixed(members.filter(F.col("at") < FIRST_BANDS) if step == 0 else members, labels, step)
        if open_.isEmpty():
            if step == 0:
                continue
            break
        others = open_.join(tops, "band").filter(F.col("label") != F.col("top"))
        if step < STAR_ROUNDS:
            found = others.select(F.col("key").alias("x"), F.col("head").alias("y"))
        else:
            found = _apart(others, open_, nodes, texts, similarity)
        pairs = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "dedup")
        links = stored(_verified(pairs, texts, similarity), "dedup")
        tested = tested.union(pairs)
        labels = _merged(labels, links)

    named = signed.select("doc_id", "th", "key").join(labels.withColumnRenamed("node", "key"), "key", "left")
    named = named.withColumn("label", F.coalesce("label", "key"))
    heads = named.groupBy("label").agg(
        F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "th")).alias("head"), F.count(F.lit(1)).alias("n_class")
    )
    return named.join(heads, "label").select(
        "doc_id", "th", "class_id", "n_class", F.struct("doc_id", "th").eqNullSafe(F.col("head")).alias("is_head")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id (of equal rows, one)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = classes(docs, id_col, text_col).filter("is_head").select(F.col("doc_id").alias("_i"), "th").distinct()
    carried = docs.select(row.alias("doc"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"))
    same = (F.col("_th") == F.col("th")) & F.col("_id").eqNullSafe(F.col("_i"))
    kept = carried.join(found, same).dropDuplicates(["_id", "_th"])
    return kept.select("doc.*")
