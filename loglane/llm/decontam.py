"""Benchmark decontamination by a generalised suffix automaton of the test items.

The normalised words of all items make one automaton, whose states stand for all runs of words that occur in an item.
Training words are streamed through it; at each word the automaton is in the state of the longest run of words that
ends there and occurs in some item, and the length of that run is tracked. Where the length reaches the window, a
window of an item ends at this word; shorter items are found whole, at a state on the path of suffix links.

Items are cut into pieces of bounded length, which overlap by a window less one word, and dealt into parts of bounded
size. Each part's automaton is built in a task, written to shared storage and sent to the executors alone; documents
are read once for each part. A set of items of up to ``PART_WORDS`` words, ten times the usual size, is one part.

A task cuts its stream of words into lanes, each of which begins a window early, and moves all lanes on by one word at
a time, so that steps are array operations. Words are compared by 64-bit hashes: for V different words of items and N
different words of documents, the odds of one false match are about V * N / 2**64.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglane.llm.shared import LOWER, bytes_of, hashes, runs, slices, store, texts_of

# Words of the items of one automaton, about, and of a piece of an item.
PART_WORDS = 1 << 17
PIECE_WORDS = 1 << 12
# Words that a lane takes in a pass, besides those before it.
LANE = 256
# Bytes of text streamed at a time.
STREAM_BYTES = 4 << 20

# Bytes between words, once A-Z are lower-cased: ASCII but for 0-9 and a-z.
GAP = np.zeros(256, bool)
GAP[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin, end and row of each word."""
    raw = LOWER[raw]
    begins, ends, rows = runs(raw, offsets, GAP)
    return hashes(raw, begins, ends), begins, ends, rows


class Slots:
    """Numbers of keys, by open addressing: many keys are looked up at once."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            # Of the keys that meet at a free slot one takes it, the others go on.
            free = self.value[at] < 0
            self.value[at[free]] = left[free]
            won = self.value[at] == left
            self.key[at[won]] = keys[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys, -1 for unknown ones."""
        at = self._home(keys)
        found = self.value[at]
        left = np.flatnonzero((found >= 0) & (self.key[at] != keys))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found[left] = self.value[at[left]]
            left = left[(found[left] >= 0) & (self.key[at[left]] != keys[left])]
        return found

    @classmethod
    def restored(cls, parts: dict) -> Slots:
        slots = cls.__new__(cls)
        vars(slots).update(parts)
        return slots


class Automaton:
    """The runs of words of the given pieces of items.

    ``pieces`` has an item's number and the hashes of its words each. An entry is a window of an item, or a whole item
    of fewer words, at the state that stands for it; ``up`` leads from a state to the nearest one on its suffix path,
    itself included, that has entries.
    """

    def __init__(self, pieces: list[tuple[int, np.ndarray]], width: int):
        self.width = width
        vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *[p for _, p in pieces]]))
        self.vocabulary, self.n_words = Slots(vocabulary), max(1, len(vocabulary))
        self._goes: list[dict[int, int]] = [{}]
        self._link, self._length = [-1], [0]
        coded = [(item, np.searchsorted(vocabulary, p).tolist()) for item, p in pieces]
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self._extended(last, code)
        entries = sorted({x for item, codes in coded for x in self._entries(item, codes)})
        self.link, self.length = np.array(self._link, np.int32), np.array(self._length, np.int32)

        # Entries by state and length; the items of each are a range of ``items``.
        states, lengths, items = np.array(entries, np.int64).reshape(-1, 3).T
        new = np.ones(len(states), bool)
        new[1:] = (states[1:] != states[:-1]) | (lengths[1:] != lengths[:-1])
        first = np.flatnonzero(new)
        self.entry_length, self.items = lengths[first], items
        self.item_cuts = np.append(first, len(items))
        self.entry_cuts = np.searchsorted(states[first], np.arange(len(self.link) + 1))

        self.up = np.where(np.diff(self.entry_cuts) > 0, np.arange(len(self.link)), -1).astype(np.int32)
        for s in np.argsort(self.length, kind="stable").tolist():
            if self.up[s] < 0 and s:
                self.up[s] = self.up[self.link[s]]

        moves = [(s * self.n_words + code, to) for s, goes in enumerate(self._goes) for code, to in goes.items()]
        keys, self.target = np.array(moves, np.int64).reshape(-1, 2).T
        self.moves, self.target = Slots(keys), self.target.astype(np.int32)
        del self._goes, self._link, self._length

    def _state(self, length: int, goes: dict[int, int], link: int) -> int:
        self._goes.append(goes)
        self._length.append(length)
        self._link.append(link)
        return len(self._link) - 1

    def _split(self, before: int, code: int) -> int:
        """The state of the run that ``before`` and ``code`` make, apart from longer runs that share its state."""
        to = self._goes[before][code]
        if self._length[to] == self._length[before] + 1:
            return to
        apart = self._state(self._length[before] + 1, dict(self._goes[to]), self._link[to])
        self._link[to] = apart
        while before >= 0 and self._goes[before].get(code) == to:
            self._goes[before][code] = apart
            before = self._link[before]
        return apart

    def _extended(self, last: int, code: int) -> int:
        """The state of the run that ends one word later."""
        if code in self._goes[last]:
            return self._split(last, code)
        state, at = self._state(self._length[last] + 1, {}, 0), last
        while at >= 0 and code not in self._goes[at]:
            self._goes[at][code] = state
            at = self._link[at]
        if at >= 0:
            self._link[state] = self._split(at, code)
        return state

    def _entries(self, item: int, codes: list[int]) -> Iterator[tuple[int, int, int]]:
        state, size = 0, min(self.width, len(codes))
        for i, code in enumerate(codes):
            state = self._goes[state][code]
            while self._length[self._link[state]] >= size:
                state = self._link[state]
            if i + 1 >= size:
                yield state, size, item

    def _moved(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        k = self.moves.find((states.astype(np.int64) * self.n_words + codes).astype(np.uint64))
        return np.where(k >= 0, self.target[k], -1)

    def stream(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and length of the longest match at each word, exact up to the window; -1 stands for unknown words."""
        early, n = self.width - 1, len(codes)
        lanes = -(-n // LANE)
        wide = np.full(early + lanes * LANE, -1, np.int64)
        wide[early : early + n] = codes
        lane = np.lib.stride_tricks.as_strided(wide, (lanes, early + LANE), (LANE * 8, 8))
        at = np.ascontiguousarray(lane.T)
        states, lengths = np.zeros((early + LANE, lanes), np.int32), np.zeros((early + LANE, lanes), np.int32)
        state, length = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        for step, code in enumerate(at):
            known = code >= 0
            active = np.flatnonzero(known)
            state[~known], length[~known] = 0, 0
            s, c = state[active], code[active]
            while len(active):
                to = self._moved(s, c)
                went = to >= 0
                state[active[went]] = to[went]
                length[active[went]] += 1
                # Without a move, the next shorter suffix tries; the empty one knows every word.
                active, c = active[~went], c[~went]
                s = self.link[s[~went]]
                length[active] = self.length[s]
            states[step], lengths[step] = state, length
        return states[early:].T.ravel()[:n], lengths[early:].T.ravel()[:n]

    def found(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places at which an entry ends, and the entry of each."""
        states, lengths = self.stream(codes)
        place = np.flatnonzero(self.up[states] >= 0)
        at, places, entries = self.up[states[place]], [], []
        while len(place):
            first, n = self.entry_cuts[at], self.entry_cuts[at + 1] - self.entry_cuts[at]
            entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            where = np.repeat(place, n)
            fits = self.entry_length[entry] <= lengths[where]
            places.append(where[fits])
            entries.append(entry[fits])
            at = np.where(at > 0, self.up[self.link[at]], -1)
            place, at = place[at >= 0], at[at >= 0]
        none = np.empty(0, np.int64)
        return np.concatenate([none, *places]), np.concatenate([none, *entries])

    def codes(self, words: np.ndarray) -> np.ndarray:
        return self.vocabulary.find(words)

    def packed(self) -> bytes:
        return pickle.dumps({k: vars(v) if isinstance(v, Slots) else v for k, v in vars(self).items()})

    @classmethod
    def unpacked(cls, blob: bytes) -> Automaton:
        automaton = cls.__new__(cls)
        vars(automaton).update({k: Slots.restored(v) if isinstance(v, dict) else v for k, v in pickle.loads(blob).items()})
        return automaton


def covered(places: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run that ends at one of the places."""
    change = np.bincount(places - lengths + 1, minlength=n + 1) - np.bincount(places + 1, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def _pieces(items: DataFrame, width: int) -> DataFrame:
    """``item, piece, words`` (packed hashes) of the items that have words; null texts have none."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            for at, to in slices(texts):
                hashed, _, _, rows = words_of(*bytes_of(texts, at, to))
                cuts = np.searchsorted(rows, np.arange(to - at + 1))
                out = [
                    (i, piece, hashed[b : min(b + PIECE_WORDS + width - 1, cuts[i + 1])].tobytes())
                    for i in range(to - at)
                    for piece, b in enumerate(range(cuts[i], max(cuts[i + 1] - width + 1, min(cuts[i + 1], cuts[i] + 1)), PIECE_WORDS))
                ]
                if out:
                    index, piece, blob = zip(*out, strict=True)
                    item = batch.column(0)[at:to].take(pa.array(index))
                    yield pa.record_batch({"item": item, "piece": pa.array(piece, pa.int64()), "words": pa.array(blob, pa.binary())})

    rows = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(fn, "item string, piece long, words binary")


def _automata(items: DataFrame, width: int, part_words: int) -> tuple[DataFrame, int]:
    """A row ``part, automaton, items`` for each part of the items, and the number of parts."""
    pieces = store(_pieces(items, width), "pieces")
    words = pieces.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0] // 8
    parts = -(-words // part_words)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        names = whole["item"].to_pylist()
        number = {name: i for i, name in enumerate(dict.fromkeys(names))}
        rows = [(number[name], np.frombuffer(x, np.uint64)) for name, x in zip(names, whole["words"].to_pylist(), strict=True)]
        blob = Automaton(rows, width).packed()
        yield pa.record_batch({"part": whole["part"][:1].combine_chunks(), "automaton": pa.array([blob], pa.binary()), "items": pa.array([list(number)], pa.list_(pa.string()))})

    dealt = pieces.dropDuplicates().withColumn("part", F.pmod(F.xxhash64("item", "piece"), F.lit(max(1, parts))))
    return store(dealt.groupBy("part").applyInArrow(fn, "part long, automaton binary, items array<string>"), "automata"), parts


def _streamed(rows: DataFrame, automata: DataFrame, part: int, keep_text: bool) -> DataFrame:
    """``rows`` (``row, text, n_words, spans, items``) with what the part's automaton finds added."""
    got = automata.filter(F.col("part") == part).first()
    if got is None:
        return rows if keep_text else rows.drop("text")
    shared = rows.sparkSession.sparkContext.broadcast((bytes(got["automaton"]), got["items"]))
    columns = [c for c in rows.columns if c != "text" or keep_text]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, names = Automaton.unpacked(shared.value[0]), shared.value[1]
        for batch in batches:
            texts = texts_of(batch, "text")
            for at, to in slices(texts, STREAM_BYTES):
                counts, found = _found(automaton, texts, at, to)
                out = {c: batch.column(batch.schema.get_field_index(c))[at:to] for c in columns}
                spans, n_hit = _added(out["spans"], out["n_hit"], found)
                out |= {"n_words": pa.array(counts), "n_hit": n_hit, "spans": spans, "items": _added_items(out["items"], found, names)}
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, out[c].type) for c in columns]))

    return rows.mapInArrow(fn, rows.select(*columns).schema)


def _found(automaton: Automaton, texts: pa.Array, at: int, to: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The words of each row, and for rows with finds: row, flat spans of words, numbers of items."""
    hashed, _, _, rows = words_of(*bytes_of(texts, at, to))
    n = to - at
    cuts = np.searchsorted(rows, np.arange(n + 1))
    # An unknown word stands between rows, so no run goes over their ends.
    codes = np.full(len(hashed) + n, -1, np.int64)
    codes[np.arange(len(hashed)) + rows] = automaton.codes(hashed)
    places, entries = automaton.found(codes)
    if not len(places):
        return np.diff(cuts), []
    hit = covered(places, automaton.entry_length[entries], len(codes))
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    begins, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    starts = cuts[:-1] + np.arange(n)
    span_row, place_row = (np.searchsorted(starts, x, "right") - 1 for x in (begins, places))
    pairs = np.unique(np.stack([place_row, entries], axis=1), axis=0)
    out = []
    for row in np.unique(span_row).tolist():
        a, b = np.searchsorted(span_row, (row, row + 1))
        spans = np.stack([begins[a:b], ends[a:b]], axis=1).ravel() - starts[row]
        c, d = np.searchsorted(pairs[:, 0], (row, row + 1))
        items = [automaton.items[automaton.item_cuts[e] : automaton.item_cuts[e + 1]] for e in pairs[c:d, 1].tolist()]
        out.append((row, spans, np.unique(np.concatenate(items))))
    return np.diff(cuts), out


def _added(old: pa.Array, n_hit: pa.Array, found: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[pa.Array, pa.Array]:
    """Flat spans of each row, joined with the new ones, and the words in them."""
    if not found:
        return old, n_hit
    lists, counts = old.to_pylist(), n_hit.to_numpy().copy()
    for row, spans, _ in found:
        if lists[row]:
            both = np.concatenate([np.array(lists[row], np.int64), spans]).reshape(-1, 2)
            hit = covered(both[:, 1] - 1, both[:, 1] - both[:, 0], int(both.max()))
            edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
            spans = np.stack([np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)], axis=1).ravel()
        lists[row] = spans.tolist()
        counts[row] = (spans[1::2] - spans[::2]).sum()
    return pa.array(lists, old.type), pa.array(counts)


def _added_items(old: pa.Array, found: list[tuple[int, np.ndarray, np.ndarray]], names: list[str | None]) -> pa.Array:
    if not found:
        return old
    lists = old.to_pylist()
    for row, _, items in found:
        known = {*lists[row], *[names[i] for i in items.tolist()]}
        lists[row] = sorted(known, key=lambda x: (x is None, x or ""))
    return pa.array(lists, old.type)


def matches(docs: DataFrame, items: DataFrame, width: int = 10, keep: list[str] | None = None, part_words: int = PART_WORDS) -> DataFrame:
    """``row`` (the columns ``keep`` of ``docs``, all by default), ``n_words, n_hit, spans, items`` for every row of ``docs``.

    ``docs`` has ``text``, ``items`` has ``item_id, text``; more columns are ignored. A window is ``width`` consecutive
    words of an item, or all words of an item of fewer. ``n_hit`` counts the words of the document inside an occurrence
    of a window; ``spans`` lists the longest runs of such words as flat pairs (first word, word after the last), and
    ``items`` the ids, as sorted strings, of the items that have a window there. Null and wordless texts have no words,
    and such items no windows. Items of one id count as one; a null id is listed as null, last. Repeated documents get
    equal results each. No documents give no rows, no items no hits. Texts may be of any length.
    """
    if width < 1 or part_words < 1:
        raise ValueError("width and part_words must be positive")
    row = F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row")
    rows = docs.select(
        row, F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    automata, parts = _automata(items, width, part_words)
    if not parts:
        # Words are counted all the same.
        automata, parts = docs.sparkSession.createDataFrame([(0, bytearray(Automaton([], width).packed()), [])], automata.schema), 1
    for part in range(parts):
        rows = _streamed(rows, automata, part, keep_text=part < parts - 1)
        if part < parts - 1:
            rows = store(rows, "streamed")
    return rows.select("row", "n_words", "n_hit", "spans", "items")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, least_words: int = 13, most_share: float = 0.5) -> DataFrame:
    """``row, n_words, n_hit, spans, items`` as :func:`matches`, ``clean_text`` and ``kept``.

    ``clean_text`` is the text without its spans of ``least_words`` words or more (a null text stays null); ``kept`` is
    false where the hit words are more than ``most_share`` of all words. Names of columns may clash with these: the
    document's own are fields of ``row``.
    """
    rows = matches(docs, items, width)
    text = next(c for c in docs.columns if c.lower() == "text")
    rows = rows.withColumn("clean_text", F.col("row").getField(text).cast("string"))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(batch.schema.get_field_index("clean_text")), batch.column(batch.schema.get_field_index("spans")).to_pylist()
            out = texts.to_pylist()
            for i, flat in enumerate(spans):
                pairs = [(a, b) for a, b in zip(flat[::2], flat[1::2], strict=True) if b - a >= least_words]
                if pairs:
                    raw = out[i].encode()
                    _, begins, ends, _ = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    edges = [0, *[int(x) for a, b in pairs for x in (begins[a], ends[b - 1])], len(raw)]
                    out[i] = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"clean_text": pa.array(out, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    out = rows.mapInArrow(fn, rows.schema)
    return out.withColumn("kept", F.col("n_hit") <= F.lit(most_share) * F.col("n_words"))


# The query's result in SQL, by all windows as strings.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT k FROM windows),
  grams AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
  found AS (SELECT doc_id, i, k, item_id FROM grams JOIN windows USING (k, g)),
  hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
