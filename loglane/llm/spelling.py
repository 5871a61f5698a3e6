"""Spelling variants of words by PartEnum signatures.

The letters of a word, with repeats, are a binary vector: one place for each letter and number of its occurrence. One
inserted, deleted or replaced letter changes at most two places, so near words are vectors within a Hamming distance of
two. The letters are dealt into ``PARTS`` parts by their code points; two near words differ in two parts at most, so
for each choice of two parts to leave out, the letters in the other parts, projected exactly, are a signature, and near
words agree on at least one of them.

Letters say nothing of order, and words of few syllables share many of them. So a signature also holds two thirds of
the word itself, position by position: with one change only, the first and the second third, or the second and the
last (counted from the end), or the first and the last are equal in both words. Lengths fall into classes, which decide
how long the thirds are; a word whose longer neighbours belong to the next class has the signatures of both.

Words are joined on equal signatures: rows are dealt and sorted by the signature, and each run of equal ones is
verified letter by letter as it passes, so only near words are written. The words of one signature have two thirds of
their letters in common, in place, which leaves few of them, however many words there are.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglane.llm.shared import slices, store, texts_of

# Parts of the letters, and parts that near words may differ in.
PARTS, DIFFER = 3, 2
# Lengths of a class.
CLASS = 2
# Letters compared at a time, pairs times length.
CELLS = 1 << 22
# Different words that a task sums up before it sends them on, and words that a task signs.
FLUSH, SIGNED = 1 << 18, 1 << 14

# Runs of these letters are words.
LETTERS = "A-Za-zÀ-ÿ"

LEFT_OUT = [[p for p in range(PARTS) if p not in out] for out in itertools.combinations(range(PARTS), DIFFER)]


def signatures(word: str) -> set[tuple]:
    """What near words agree on: a choice of parts, a place of the change, letters of the parts, letters in place."""
    parts: list[list[str]] = [[] for _ in range(PARTS)]
    for c in sorted(word):
        parts[(ord(c) * 40503 >> 4) % PARTS].append(c)
    projected = ["/".join("".join(parts[p]) for p in chosen) for chosen in LEFT_OUT]
    size = len(word)
    classes = {size // CLASS, (size + 1) // CLASS}
    out = set()
    for k in classes:
        least = k * CLASS
        cuts = [0, least // 3, least - least // 3, least]
        for third in range(3):
            kept = word[: cuts[third]], word[size - min(size, least - cuts[third + 1]) :]
            out.update((choice, k, third, *kept, letters) for choice, letters in enumerate(projected))
    return out


def _keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the word and 64-bit key of each signature."""
    import xxhash

    owner, keys = [], []
    for i, word in enumerate(words):
        mine = {xxhash.xxh3_64_intdigest("\0".join(map(str, s))) for s in signatures(word)}
        owner += [i] * len(mine)
        keys += mine
    return np.array(owner, np.int64), np.array(keys, np.uint64).view(np.int64)


def _near(letters: np.ndarray, begins: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of different words are one change apart."""
    swap = sizes[a] < sizes[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    near = np.zeros(len(a), bool)
    possible = np.flatnonzero(sizes[a] - sizes[b] <= 1)
    possible = possible[np.argsort(sizes[a[possible]], kind="stable")]
    at = 0
    while at < len(possible):
        size = int(sizes[a[possible[at]]])
        same = int(np.searchsorted(sizes[a[possible]], size, "right"))
        mine = possible[at : min(same, at + max(1, CELLS // size))]
        at += len(mine)
        x, y, shorter = a[mine], b[mine], sizes[b[mine]] < size
        place = np.arange(size)
        left = letters[begins[x][:, None] + place]
        front = letters[np.minimum(begins[y][:, None] + np.minimum(place, sizes[y][:, None] - 1), len(letters) - 1)] == left
        front[shorter, -1] = False
        back = letters[np.maximum((begins[y] + sizes[y])[:, None] - 1 - place, 0)] == left[:, ::-1]
        back[shorter, -1] = False
        near[mine] = np.argmin(front, axis=1) + np.argmin(back, axis=1) >= size - 1
    return near


def _pairs(words: list[str], groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different words of equal groups that are near; ``groups`` has equal ones side by side."""
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    begins = np.cumsum(sizes) - sizes
    first = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    # Each row meets the rows of its group that follow.
    after = np.repeat(np.append(first[1:], len(groups)), np.diff(np.append(first, len(groups)))) - np.arange(len(groups)) - 1
    total = np.cumsum(after)
    at = 0
    while at < len(groups):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (CELLS >> 3), "right")))
        n = after[at:to]
        a = np.repeat(np.arange(at, to), n)
        b = a + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if len(a):
            near = _near(letters, begins, sizes, a, b)
            yield a[near], b[near]
        at = to


def near_words(words: DataFrame) -> DataFrame:
    """Each pair of near words once: ``a, n_a, b, n_b``, from different, not null, not empty words (``word, n``)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = batch.column(0).cast(pa.string()), batch.column(1)
            owner, keys = _keys(word.to_pylist())
            owner = pa.array(owner)
            yield pa.record_batch({"key": pa.array(keys), "word": word.take(owner), "n": n.take(owner)})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(rows: pa.Table) -> pa.RecordBatch:
            word, n = rows["word"].combine_chunks().cast(pa.string()), rows["n"].combine_chunks()
            texts = word.to_pylist()
            swapped = [(i, j) if texts[i] < texts[j] else (j, i) for a, b in _pairs(texts, rows["key"].to_numpy()) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            # Words that meet under several signatures of a batch are written once.
            pairs = {(texts[i], texts[j]): (i, j) for i, j in swapped}
            a, b = (pa.array([p[k] for p in pairs.values()], pa.int64()) for k in (0, 1))
            return pa.record_batch({"a": word.take(a), "n_a": n.take(a), "b": word.take(b), "n_b": n.take(b)})

        for batch in batches:
            # The last run of equal keys may go on in the next batch.
            keys = batch.column(0).to_numpy()
            if not len(keys):
                continue
            if not held or held[-1].column(0)[-1].as_py() != keys[-1]:
                cut = int(np.searchsorted(keys, keys[-1], "left"))
                yield found(pa.Table.from_batches([*held, batch[:cut]]))
                held = [batch[cut:]]
            else:
                held.append(batch)
        if held:
            yield found(pa.Table.from_batches(held))

    kind = words.schema["n"].dataType.simpleString()
    rows = words.select("word", "n").mapInArrow(sign, f"key long, word string, n {kind}")
    rows = rows.repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(meet, f"a string, n_a {kind}, b string, n_b {kind}").distinct()


def grouped(words: DataFrame, factor: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words`` (``word, n``; more columns are ignored).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. ``form`` is the near word
    with the largest ``n`` (of several, the first in order of code points) if that is at least ``factor`` times the
    word's, and else null; ``root`` is the last word that forms lead to, the word itself without one. Words must be
    different; null and empty words are left out, as are words whose ``n`` is null or not positive. No words give no rows.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more")
    words = store(words.filter("length(word) > 0 and n > 0").select("word", "n"), "words")
    rows, most, least = words.agg(F.count(F.lit(1)), F.max("n"), F.min("n")).first()
    # Signing takes longer than reading: few words are spread over more tasks than their bytes ask for.
    pairs = near_words(words.repartition(max(1, rows // SIGNED)))
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("count")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("count")),
    )).alias("x")).select("x.*")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("count")).alias("less"), "other")).alias("most"))
    rows = words.join(near, "word", "left")
    larger = -F.col("most.less") >= factor * F.col("n")
    rows = rows.select(
        "word", F.when(larger, F.col("most.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(larger, -F.col("most.less")).alias("form_n"),
    )
    rows = store(rows, "forms")
    # Counts grow by the factor with each step, which bounds the steps; each round doubles those taken.
    steps = 1 + int(math.log(most / least, factor)) if most and most > least else 1
    links = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = store(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    out = rows.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def counted(docs: DataFrame, drop_every: int | None = None, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """``word, n``: how often each word occurs in all texts of ``docs`` (``doc_id, text``; more columns are ignored).

    Words are the longest runs of ``A-Za-zÀ-ÿ``, A-Z lower-cased, of ``least_length`` code points or more; those
    with fewer than ``least_count`` occurrences are left out. Null texts have no words. ``drop_every`` makes misspellings:
    with h the unsigned crc32 of ``<doc_id>:<word>`` (a null id counts as empty), words whose h it divides lose their
    code point h modulo length, before lengths and counts are taken. Tasks send sums of the words they have seen.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(f"[{LETTERS}]{{{least_length},}}")
        held: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.record_batch({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            texts = texts_of(batch, "text")
            for at, to in slices(texts):
                for doc, text in zip(batch.column(0)[at:to].to_pylist(), texts[at:to].to_pylist(), strict=True):
                    # In bytes, lower() changes A-Z alone.
                    seen = Counter(pattern.findall(text.encode().lower().decode()))
                    begin = zlib.crc32(f"{doc}:".encode())
                    for word, n in seen.items():
                        if drop_every and (h := zlib.crc32(word.encode(), begin)) % drop_every == 0:
                            h %= len(word)
                            word = word[:h] + word[h + 1 :]
                            if len(word) < least_length:
                                continue
                        held[word] = held.get(word, 0) + n
                if len(held) > FLUSH:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(fn, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# The query's result in SQL: crc32 by its table of bytes, near words by marks and cuts at every place.
SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
  runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
  once AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
  hashed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(x), 2), lambda i:
    (strpos('0123456789ABCDEF', x[i]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 1)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM once, crc),
  cut AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
  v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
  spots AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
  marks AS (SELECT word, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS m FROM spots),
  cuts AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS c FROM spots),
  longer AS (SELECT cuts.word AS a, v.word AS b FROM cuts JOIN v ON v.word = cuts.c),
  near AS (SELECT a.word AS a, b.word AS b FROM marks a JOIN marks b ON a.m = b.m AND a.word <> b.word
    UNION SELECT a, b FROM longer UNION SELECT b, a FROM longer),
  ranked AS (SELECT a, b, v.n AS m, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS r
    FROM near JOIN v ON near.b = v.word),
  forms AS MATERIALIZED (SELECT word, CASE WHEN m >= 5 * n THEN b END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * n THEN m END AS form_n
    FROM v LEFT JOIN ranked ON ranked.a = v.word AND r = 1),
  path AS (SELECT word, word AS root, form AS next FROM forms
    UNION ALL SELECT path.word, forms.word, forms.form FROM path JOIN forms ON path.next = forms.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM path WHERE next IS NULL) USING (word)
"""
