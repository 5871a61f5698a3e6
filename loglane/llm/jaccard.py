"""N-gram Jaccard join by a token-group matrix.

Documents become sets of hashed word shingles, and documents with the same set become one class. Classes that
could be similar meet through *segments*: the shingles of a set are dealt into ``d + 2`` segments by their hash,
where ``d`` is the largest number of shingles in which two linked sets of that size can differ. Two linked sets
therefore agree on two segments at least, one of them not empty (sets with two empty segments or more meet under a
mark of their own). A segment holds several shingles, so a passage that many documents share seldom fills one.

The search then has two steps:

1. Every class is compared with the least class it shares a segment with. This joins large families of near
   copies with one comparison or a few per member. Their components are the first result.
2. Token-group matrix: classes are partitioned into groups (large components apart, others by the component of a
   leader of the leader they share most segments with), and groups, in order of size, into blocks of bounded shingles. The matrix has
   a row for each (segment, block). A class of another component whose segments meet a block's row, and whose size is
   near that of the row's members, queries that block: its overlap with the union of the block's shingles bounds its
   overlap with every member, and only blocks whose bound reaches the threshold are opened and compared member by
   member. Classes of smaller components query those of larger ones, never the other way, so a large family of near
   copies queries nothing for the few that are left outside of it.

No pairs inside a component are enumerated and none outside are left out, so the components are exact, up to
collisions of 64-bit hashes (for N different sets, odds of about N*N / 2**65 for one false merge).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglane.llm.components import components
from loglane.llm.shared import (
    LOWER, NARROW_ROWS, SPACE, arrow_rows, bytes_of, distinct_per_row, hashes, in_batches, mix, runs, slices, store, sums_between, texts_of,
)

# Shingles of a block of the matrix, about, and queries that one task holds against a block.
BLOCK_SHINGLES = 1 << 20
QUERY_ROWS = 512
# Components of this size have groups of their own; others are grouped by their leader's leader, so many times.
OWN_GROUP, LEADERS = 32, 2
# Segments kept before they are sent on.
FLUSH = 1 << 20

M1, M2, M3 = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and where each text begins.

    Bytes A-Z are lower-cased; words are runs without ASCII white space. A text with fewer than ``width`` words
    has its whole sequence as its one shingle, a text without words none.
    """
    raw = LOWER[raw]
    begins, ends, rows = runs(raw, offsets, SPACE)
    words = hashes(raw, begins, ends)
    n = len(offsets) - 1
    counts = np.bincount(rows, minlength=n)
    ends_of = np.cumsum(counts)
    place = np.arange(len(words)) - np.repeat(ends_of - counts, counts)
    left = np.repeat(counts, counts) - place
    short = np.repeat(counts < width, counts)
    keep = np.where(short, place == 0, left >= width)
    at = np.flatnonzero(keep)
    with np.errstate(over="ignore"):
        value = np.zeros(len(at), np.uint64)
        for k in range(width):
            inside = left[at] > k
            value = mix(value * M1 + np.where(inside, words[np.minimum(at + k, len(words) - 1)], M2), k + 1)
    return distinct_per_row(value, rows[at], n)


def keys_of(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set."""
    size = np.diff(cuts).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix(sums_between(mix(values, 11), cuts) * M1 + mix(sums_between(mix(values, 12), cuts), 13) + size, 14)


def size_bounds(percent: int, largest: int) -> np.ndarray:
    """First sizes of the size classes: linked sets lie in the same or in neighbouring classes."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return np.array([*bounds, bounds[-1] * 100 // percent + 1], np.int64)


def segments(values: np.ndarray, cuts: np.ndarray, keys: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the segments of all sets, and the key of the set of each."""
    sizes = np.diff(cuts)
    bounds = size_bounds(percent, int(sizes.max(initial=1)))
    level = np.searchsorted(bounds, sizes, "right") - 1
    out = []
    for up in (0, 1):
        top = bounds[np.minimum(level + up + 1, len(bounds) - 1)] - 1
        differ = 2 * top * (100 - percent) // (100 + percent)
        parts = np.where((differ > 0) & (sizes > 0), differ + 2, 0)
        owner = np.repeat(np.arange(len(sizes)), np.where(parts > 0, sizes, 0))
        mine = values[np.repeat(parts > 0, sizes)]
        base = np.cumsum(parts) - parts
        part = (mix(mine, 21) >> np.uint64(20)) % np.maximum(parts, 1)[owner].astype(np.uint64)
        slot = base[owner] + part.astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot, owner, mine = slot[order], owner[order], mix(mine[order], 22)
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.empty(0, np.int64)
        seg_owner, seg = owner[first], slot[first] - base[owner[first]]
        with np.errstate(over="ignore"):
            mark = mix((level[seg_owner] + up).astype(np.uint64) * M2 + seg.astype(np.uint64), 23)
            found = mix(sums_between(mine, np.append(first, len(mine))) + mark, 24)
            full = np.bincount(seg_owner, minlength=len(sizes))
            sparse = np.flatnonzero((parts > 0) & (parts - full >= 2))
            empty = mix((level[sparse] + up).astype(np.uint64) * M3, 25)
        out += [(found, keys[seg_owner]), (empty, keys[sparse])]
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _tasks(docs: DataFrame) -> int:
    return docs.rdd.getNumPartitions()


def _address() -> Column:
    """By which a row is found again: its id, or its text where it has none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), F.xxhash64("text"))).alias("at")


def sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, at, n_shingles, key`` of every row; the key of an empty set is null."""

    def fn(batch: pa.RecordBatch) -> pa.Table:
        texts, n, keys = texts_of(batch, "text"), [], []
        for at, to in slices(texts):
            values, cuts = shingle_sets(*bytes_of(texts, at, to), width)
            n.append(np.diff(cuts))
            keys.append(keys_of(values, cuts))
        n, keys = np.concatenate(n), np.concatenate(keys)
        key = pa.array(keys.view(np.int64), mask=n == 0)
        return pa.table({"doc_id": batch.column(0), "at": batch.column(1), "n_shingles": pa.array(n.astype(np.int64)), "key": key})

    docs = docs.select("doc_id", _address(), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(in_batches(fn, ""), f"doc_id {kind}, at string, n_shingles long, key long")


def shared_segments(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``seg, key``: segments that two classes or more have.

    Segments travel packed, sixteen bytes each, to as many buckets as keep a bucket small; one task has every
    class once per segment.
    """
    buckets = max(512, 8 * _tasks(docs))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            rows = np.unique(np.concatenate(held), axis=0)
            bucket = (mix(rows[:, 0], 31) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            blobs = [x.tobytes() for x in np.split(rows, first[1:])]
            return pa.record_batch({"bucket": pa.array(bucket[first]), "packed": pa.array(blobs, pa.binary())})

        held, size = [], 0
        for batch in batches:
            texts = texts_of(batch, "text")
            for at, to in slices(texts):
                values, cuts = shingle_sets(*bytes_of(texts, at, to), width)
                found = np.stack(segments(values, cuts, keys_of(values, cuts), percent), axis=1)
                held.append(found)
                size += len(found)
                if size > FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = [x for b in batches for x in b.column(b.schema.get_field_index("packed")).to_pylist()]
        rows = np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, 2) for x in packed])
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        same = rows[1:, 0] == rows[:-1, 0]
        keep = np.concatenate(([True], ~(same & (rows[1:, 1] == rows[:-1, 1]))))
        rows = rows[keep]
        same = rows[1:, 0] == rows[:-1, 0]
        rows = rows[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        if len(rows):
            yield pa.record_batch({"seg": _signed(rows[:, 0].copy()), "key": _signed(rows[:, 1].copy())})

    packed = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(emit, "bucket long, packed binary")
    return packed.groupBy("bucket").applyInArrow(meet, "seg long, key long")


def token_table(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """``key, tokens`` (packed sorted hashes) of the wanted classes.

    Only one document of each class is read; a text counts when its own key is the wanted one.
    """

    def fn(batch: pa.RecordBatch) -> pa.Table:
        texts, keys, tokens = texts_of(batch, "text"), [], []
        for at, to in slices(texts):
            values, cuts = shingle_sets(*bytes_of(texts, at, to), width)
            keys.append(keys_of(values, cuts))
            tokens += [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        wanted = batch.column(batch.schema.get_field_index("wanted"))
        out = pa.table({"key": _signed(np.concatenate(keys)), "wanted": wanted, "tokens": pa.array(tokens, pa.binary())})
        return out.filter(pc.equal(out["key"], out["wanted"])).select(["key", "tokens"])

    docs = docs.select(F.col("text").cast("string").alias("text"), _address())
    rows = docs.join(classes.select("at", F.col("key").alias("wanted")), "at").select("wanted", "text")
    return rows.mapInArrow(in_batches(fn, ""), "key long, tokens binary").groupBy("key").agg(F.first("tokens").alias("tokens"))


def _linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that are linked, by their whole sets."""

    def fn(batch: pa.RecordBatch) -> pa.Table:
        kept = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            least = min(len(x), len(y))
            if 100 * least < percent * max(len(x), len(y)):
                kept.append(False)
                continue
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            kept.append(bool(100 * common >= percent * (len(x) + len(y) - common)))
        return pa.table({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(kept, pa.bool_()))

    left = tokens.select(F.col("key").alias("a"), F.col("tokens").alias("x"))
    right = tokens.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(in_batches(fn, ""), "a long, b long")


def open_groups(queries: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links between queries and members of the groups they qualify for.

    ``queries``: ``block, lot, key, comp, tokens``; ``members``: ``block, lot`` (one copy for each lot of queries),
    ``key, comp, tokens``.
    """

    def fn(group: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        if left.empty or right.empty:
            return none
        rows = [np.frombuffer(x, np.uint64) for x in right["tokens"]]
        sizes = np.array([len(x) for x in rows])
        flat = np.concatenate(rows)
        owner = np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        union, start = np.unique(flat, return_index=True)
        start = np.append(start, len(flat))
        comps, keys = right["comp"].to_numpy(), right["key"].to_numpy()
        found_a, found_b = [], []
        for key, comp, packed in zip(left["key"], left["comp"], left["tokens"], strict=True):
            x = np.frombuffer(packed, np.uint64)
            fits = (100 * np.minimum(sizes, len(x)) >= percent * np.maximum(sizes, len(x))) & (comps != comp) & (keys != key)
            if not fits.any():
                continue
            at = np.searchsorted(union, x)
            at = at[(at < len(union)) & (union[np.minimum(at, len(union) - 1)] == x)]
            # The overlap with the union bounds the overlap with each member.
            if not _linked(np.int64(len(at)), np.int64(len(x)), sizes[fits].min(), percent):
                continue
            lengths = start[at + 1] - start[at]
            inside = np.repeat(start[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            common = np.bincount(owner[inside], minlength=len(rows))
            hit = np.flatnonzero(fits & _linked(common, np.int64(len(x)), sizes, percent))
            found_a += [key] * len(hit)
            found_b += keys[hit].tolist()
        return pd.DataFrame({"a": found_a, "b": found_b}, dtype="int64") if found_a else none

    queries, members = queries.toDF(*queries.columns), members.toDF(*members.columns)  # apart, where both come of one table
    return queries.groupBy("block", "lot").cogroup(members.groupBy("block", "lot")).applyInPandas(fn, "a long, b long")


def class_links(docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Components ``node, root`` of the classes that are linked with another class."""
    shared = store(shared_segments(docs, width, percent), "segments")
    wanted = reps.join(shared.select("key").distinct(), "key", "left_semi")
    tokens = store(token_table(docs, wanted, width), "tokens")

    leads = shared.groupBy("seg").agg(F.min("key").alias("lead"))
    votes = shared.join(leads, "seg").groupBy("key", "lead").agg(F.count(F.lit(1)).alias("votes"))
    votes = store(votes, "votes")
    near = verified(votes.filter("key <> lead").select(F.col("key").alias("a"), F.col("lead").alias("b")), tokens, percent)
    near = store(near, "links")
    first = components(near)

    # Groups: the leader most segments point to, if there is another, apart for large components, in blocks of one range of sizes.
    own = votes.groupBy("key").agg(F.max_by("lead", F.struct(F.col("lead") != F.col("key"), "votes", -F.col("lead"))).alias("lead"))
    comp = F.coalesce("root", "key").alias("comp")
    own = own.join(first.withColumnRenamed("node", "key"), "key", "left").select("key", "lead", comp)
    kin = own.groupBy("comp").agg(F.count(F.lit(1)).alias("kin"))
    own = store(own.join(kin, "comp").join(tokens.select("key", F.length("tokens").alias("size")), "key"), "own")
    # Leaders of leaders, and their component, so that what is left of a family meets in few blocks whatever its leaders.
    leaders = own.select(F.col("key").alias("lead"), F.col("lead").alias("next"), F.col("comp").alias("lead_comp"))
    for _ in range(LEADERS):
        own = own.join(leaders.drop("lead_comp"), "lead").drop("lead").withColumnRenamed("next", "lead")
    own = own.join(leaders.drop("next"), "lead")
    group = F.when(F.col("kin") >= OWN_GROUP, F.xxhash64("comp")).otherwise(F.xxhash64("lead_comp", F.lit(0)))
    own = store(own.select("key", "comp", "kin", "size", group.alias("grp")), "groups")

    # Blocks: within a group by size; a group may be large, so its blocks come from counted ranges of sizes.
    counts = own.groupBy("grp", "size").agg(F.count(F.lit(1)).alias("n"))
    by_size = Window.partitionBy("grp").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Eight bytes a shingle.
    counts = counts.withColumn("held", F.col("n") * F.col("size") / 8)
    counts = counts.withColumn("range", F.floor((F.sum("held").over(by_size) - F.col("held")) / BLOCK_SHINGLES))
    counts = counts.withColumn("splits", F.ceil(F.col("held") / BLOCK_SHINGLES))
    split = F.pmod(F.xxhash64("key", F.lit(1)), F.col("splits"))
    member = own.join(counts, ["grp", "size"]).select("key", "comp", "kin", "size", F.xxhash64("grp", "range", split).alias("block"))
    member = store(member, "members")

    # The matrix of segments and blocks, and the queries: classes that meet a row with another component.
    # The class of the smaller component queries; of two blocks with components of one size only the lesser queries the other.
    marked = store(shared.join(member, "key"), "matrix")
    row = marked.groupBy("seg", "block").agg(
        F.min("comp").alias("least"), F.max("comp").alias("most"), F.min("size").alias("small"), F.max("size").alias("big"),
        F.min("kin").alias("few"), F.max("kin").alias("many"),
    )
    several = row.groupBy("seg").agg(F.min("least").alias("x"), F.max("most").alias("y")).filter("x <> y").select("seg")
    row = row.join(several, "seg").withColumnRenamed("block", "other")
    fits = f"100 * size >= {percent} * small and 100 * big >= {percent} * size"
    asks = marked.join(row, "seg").filter(f"(kin < many or kin between few and many and block <= other) and (least <> comp or most <> comp) and {fits}")
    asks = store(asks.select(F.col("other").alias("block"), "key", "comp").distinct(), "asks")
    member = member.join(asks.select("block").distinct(), "block", "left_semi")
    lots = asks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("lots"))
    lots = store(lots, "lots")
    asks = asks.join(lots, "block").withColumn("lot", F.pmod(F.xxhash64("key", F.lit(2)), F.col("lots"))).drop("lots")
    member = member.join(lots, "block").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1)))
    far = open_groups(
        asks.join(tokens, "key").select("block", "lot", "key", "comp", "tokens"),
        member.join(tokens, "key").select("block", "lot", "key", "comp", "tokens"), percent,
    )
    far = store(far, "links")
    if far.isEmpty():
        return first
    return components(near.unionByName(far))


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text``; more columns are ignored).

    Two rows are linked when their sets of ``width``-word shingles have a Jaccard similarity of ``percent`` percent or
    more. ``component_id`` is the least ``doc_id`` that links reach. Null or wordless texts have no shingles and
    link with nothing: their component is their own id. Repeated rows are copies of each other and all stay. A null
    ``doc_id`` keeps null unless its component has an id. An empty table gives an empty result. Texts may be of any
    length. Below 50 percent the segments would be too small to be selective, so that is refused.
    """
    return _found(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the least id, all columns.

    Rows without shingles all stay. Of several rows with that id, one stays. Texts are shuffled once, by id.
    """
    rows = _found(docs, width, percent).filter("key is null or doc_id <=> component_id")
    win = rows.groupBy("at").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("key").isNotNull()).alias("words"))
    win = store(win, "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = docs.select(row, _address()).join(win, "at")
    again = win.filter("rows > 1 and words")
    if not again.isEmpty():
        # Rows of one id that are copies of each other, or that belong to different components.
        def fn(batch: pa.RecordBatch) -> pa.Table:
            texts, keys = texts_of(batch, "text"), []
            for at, to in slices(texts):
                values, cuts = shingle_sets(*bytes_of(texts, at, to), width)
                keys.append(np.where(np.diff(cuts) > 0, keys_of(values, cuts).view(np.int64), 0))
            return pa.table({"row": batch.column(0), "at": batch.column(1), "key": pa.array(np.concatenate(keys))})

        one = out.filter("rows > 1 and words").select("row", "at", F.col("row.text").cast("string").alias("text"))
        schema = T.StructType([one.schema["row"], one.schema["at"], T.StructField("key", T.LongType())])
        roots = rows.select("at", "key", "root").distinct()
        one = store(one.mapInArrow(in_batches(fn, ""), schema), "repeated")
        bare = one.filter("key = 0").select("row")
        one = one.join(roots, ["at", "key"]).groupBy("at", "root").agg(F.first("row").alias("row")).select("row")
        out = out.filter("not (rows > 1 and words)").select("row").unionByName(bare).unionByName(one)
    return out.select("row.*")


def _found(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, at, n_shingles, key, root, component_id`` of every row."""
    if not 50 <= percent < 100 or width < 1:
        raise ValueError("width must be positive and percent from 50 to 99")
    # Only texts travel, without their rows.
    arrow_rows(docs, NARROW_ROWS)
    docs = docs.select("doc_id", "text")
    found = store(sets(docs, width), "sets")
    reps = found.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.min("at").alias("at"))
    comps = class_links(docs, reps.select("key", "at"), width, percent)
    whole = reps.drop("at").join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = whole.join(least, "root").select("key", "root", "component_id")
    out = found.join(whole, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "at", "n_shingles", "key", "root", component.alias("component_id"))


# The query's result in SQL, by all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct([array_to_string(w[i : i + 2], ' ') FOR i IN range(1, len(w) - 1)])) END AS s FROM words),
  classes AS (SELECT s, min(doc_id) AS least, row_number() OVER () AS c FROM sets WHERE len(s) > 0 GROUP BY s),
  tokens AS (SELECT c, len(s) AS n, unnest(s) AS t FROM classes),
  common AS (SELECT a.c AS a, b.c AS b, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS k FROM tokens a JOIN tokens b
    ON a.t = b.t AND a.c <> b.c AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.c, b.c),
  links AS (SELECT a, b FROM common WHERE 100 * k >= 90 * (x + y - k)),
  reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
  root AS (SELECT r.a AS c, min(k.least) AS component_id FROM reach r JOIN classes k ON r.b = k.c GROUP BY r.a)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN classes ON len(sets.s) > 0 AND sets.s = classes.s LEFT JOIN root USING (c)
"""
