"""Suffix-array dedup: 50-byte strings that also start in an earlier document, found by a collection's BWT and LCP.

The Burrows-Wheeler transform and the common prefixes of a collection are built column by column: each round inserts
one symbol of every text, from its end to its start, in sequential passes over files that hold the list so far
(``ColumnFiles``). A corpus is too large, and its documents too long, for one such collection, so Spark first cuts it
into collections that no repeated string crosses:

0. Equal texts are combined, as every hot group is: those of larger doc_ids are covered by the first and take no part.
1. Every 50-byte string is keyed by the least hash of its 20-byte parts. Equal strings have equal keys, and
   neighbouring strings mostly share one, so a document is a row of runs with one key each.
2. Keys go through one shuffle, a task's own repetitions combined first. Keys that two documents share come back.
3. The runs with such keys are cut out of their documents and dealt by key. Equal runs are combined before the shuffle:
   the one with the least doc_id is sent on, and the others are covered by it. What arrives is combined once more, so a
   collection has each distinct run of its keys once, owned by the least doc_id that has it. A run that one document has
   is left out if no other document's run of its key has the part before or after it too: they have no common string.
4. Strings with a common prefix of 50 in the sorted list are equal; the least owner among them says which documents
   lose them. The covered bytes go back to their documents.

A collection is whole keys with about ``most_pieces`` runs, of similar length: its rounds are the bytes of its longest. Its list is in two files (symbols and common prefixes) in
the shared folder, read and written a chunk of ``chunk`` rows at a time; only numbers for each text are in memory.
Documents are shuffled once, for steps 3 and 4.

Defined cases: a null text is empty; texts under 50 bytes lose nothing; documents with the same doc_id do not take
strings from each other; a null doc_id is smaller than every other; repeated rows get the same result; an empty table
gives an empty result. Very long texts go in blocks of their own and are cut into runs of one key, so no collection has
a whole one. Columns besides those that an operator names are not read by it, or are handed on as they are, whatever
their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut_lineage, mix64, shared_dir, ship_package, table
from .minhash import grouped_rows, group_bounds

LENGTH, PART = 50, 20
SIDE = (LENGTH - PART) // 2  # what a string has on one side of a part in it, at least
FACTOR = np.uint64(0xD1342543DE82EF95)
BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
NO_ID = -(2**63)
BLOCK = 2_000_000  # characters at a time: hashing takes some sixty bytes of memory for each
MOST_STARTS = 32  # of one run; longer ones, as of one word repeated, are cut


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(FACTOR), n, 1 << 64))


def joined(first: np.ndarray, second: np.ndarray | None, size: int, factor: np.uint64 | None = None) -> np.ndarray:
    """Hashes of what ``first`` has and, ``size`` bytes on, ``second`` (or first again)."""
    second = first if second is None else second
    out = first[: len(second) - size] * (power(size) if factor is None else factor)
    out += second[size : size + len(out)]
    return out


def part_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the PART bytes from each place on. By doubling, in whole arrays."""
    h = BYTE_CODES[data]
    h = joined(h, h, 1)  # of 2 bytes
    four = joined(h, h, 2)
    h = joined(joined(four, four, 4), None, 8)  # of 16
    return mix64(joined(h, four, 16, power(4)))


def string_keys(data: np.ndarray) -> np.ndarray:
    """For the LENGTH bytes from each place on: the least hash of their PART-byte parts, by doubling."""
    least = part_hashes(data)
    span = 1
    while 2 * span <= LENGTH - PART + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = LENGTH - PART + 1 - span
    return np.minimum(least[: len(least) - rest], least[rest:])


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring strings with one key: key, text number, first start in the text, number of starts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    keys = string_keys(data)
    cut = np.ones(len(keys), bool)
    cut[1:] = keys[1:] != keys[:-1]
    for edge in (begins, ends - LENGTH + 1):  # where a text begins, and where its strings end
        cut[edge[(edge >= 0) & (edge < len(keys))]] = True
    start = np.flatnonzero(cut)
    count = np.diff(np.append(start, len(keys)))
    doc = np.searchsorted(begins, start, "right") - 1
    own = start <= ends[doc] - LENGTH
    start, count, doc = start[own], count[own], doc[own]
    if (count > MOST_STARTS).any():
        parts = -(-count // MOST_STARTS)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, count, doc = (np.repeat(x, parts) for x in (start, count, doc))
        start = start + nth * MOST_STARTS
        count = np.minimum(count - nth * MOST_STARTS, MOST_STARTS)
    return keys[start], doc, start - begins[doc], count


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def contexts(texts: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """How often each run has the part that is its key, and for its first: the text number and a hash of the parts SIDE before and after it.

    The strings of a run that begin SIDE bytes or more before that part have the one before it, the others that after it.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    parts = part_hashes(np.frombuffer(b"".join(texts), np.uint8))
    number = np.repeat(np.arange(len(texts)), sizes)[: len(parts)]
    hit = np.flatnonzero(parts == keys[number])
    hit = hit[hit <= ends[number[hit]] - PART]
    of = number[hit]
    at = hit[np.searchsorted(of, np.arange(len(texts)))]
    before = np.flatnonzero(at - SIDE >= ends - sizes)
    after = np.flatnonzero(at + SIDE + PART <= ends)
    sides = np.concatenate([parts[at[before] - SIDE], ~parts[at[after] + SIDE]])
    both = np.concatenate([before, after])
    return np.bincount(of, minlength=len(texts)), both, mix64(keys[both] + sides * FACTOR)


def may_share(texts: list[bytes], keys: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which runs two documents have (``least`` and ``most`` of their ids), or may have a string in common with another document's.

    Two runs can only have a string in common where one of the parts beside their key is the same. Runs that have their
    key's part more than once, and those of the same key, all stay.
    """
    often, of, sides, size = np.zeros(len(texts), bool), [], [], max(BLOCK // (LENGTH + MOST_STARTS), 1)
    for lo in range(0, len(texts), size):
        times, number, side = contexts(texts[lo : lo + size], keys[lo : lo + size])
        often[lo : lo + size] = times > 1
        of.append(number + lo)
        sides.append(side)
    out = (least < most) | np.isin(keys, keys[often])
    of, sides = np.concatenate(of), np.concatenate(sides)
    order = np.argsort(sides)
    of, sides = of[order], sides[order]
    group = np.flatnonzero(np.append(True, sides[1:] != sides[:-1]))
    several = np.minimum.reduceat(least[of], group) < np.maximum.reduceat(least[of], group)
    out[of[np.repeat(several, np.diff(np.append(group, len(of))))]] = True
    return out


class ColumnFiles:
    """Two files of a byte a row, symbols and common prefixes, and the two that the next round makes of them."""

    KINDS = ("bwt", "lcp")

    def __init__(self, folder: str, chunk: int):
        from pyarrow import fs

        self.store, path = fs.FileSystem.from_uri(folder)
        self.path, self.chunk, self.round = f"{path}/{uuid.uuid4().hex}", chunk, 0
        self.store.create_dir(self.path)

    def name(self, kind: str, turn: int) -> str:
        return f"{self.path}/{turn % 2}.{kind}"

    def read(self) -> Iterator[tuple[np.ndarray, ...]]:
        """The current list, from its start to its end."""
        streams = [self.store.open_input_stream(self.name(k, self.round), compression=None) for k in self.KINDS]
        try:
            while len(first := streams[0].read(self.chunk)):
                yield np.frombuffer(first, np.uint8), np.frombuffer(streams[1].read(self.chunk), np.uint8)
        finally:
            for s in streams:
                s.close()

    def write(self, chunks) -> None:
        """The next list, which is the current one from then on.

        Files that are there are deleted first: some file systems send one that is cut short and rewritten to the disk at once.
        """
        if self.round > 1:
            for k in self.KINDS:
                self.store.delete_file(self.name(k, self.round + 1))
        streams = [self.store.open_output_stream(self.name(k, self.round + 1), compression=None) for k in self.KINDS]
        for rows in chunks:
            for s, column in zip(streams, rows, strict=True):
                s.write(np.ascontiguousarray(column))
        for s in streams:
            s.close()
        self.round += 1

    def delete(self) -> None:
        self.store.delete_dir(self.path)


class CollectionIndex:
    """The sorted suffixes of a collection of texts as BWT symbols and common prefixes, built by columns in files.

    A position's symbol is what stands before its suffix, 0 where nothing does. Sorting the positions by symbol, ties in
    order, lists the suffixes that are one symbol longer; that is where a round finds the places of the new ones. A new
    suffix and the one before it have one more symbol in common than the range between the positions they grew from.
    Both are found in one pass over the file, with counts and running minima for each symbol; a second pass writes the
    next file with the new positions in it.
    """

    def __init__(self, texts: list[bytes], files: ColumnFiles):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        used = np.zeros(256, bool)
        used[data] = True
        codes = (np.cumsum(used) * used)[data].astype(np.uint8)  # UTF-8 uses fewer than 255 bytes
        last = np.cumsum(sizes) - 1
        self.n, self.sizes, self.files = len(texts), sizes, files
        first = codes[last]
        files.write((first[at : at + files.chunk], np.zeros(len(first[at : at + files.chunk]), np.uint8)) for at in range(0, self.n, files.chunk))
        self.counts = np.bincount(first, minlength=256)
        active, place, step = np.arange(self.n), np.arange(self.n), 0  # texts that still grow, in the order of their longest suffixes
        while len(active):
            step += 1
            new, changed, shared = self._places(place)
            going = sizes[active] > step
            before = np.where(going, codes[np.maximum(last[active] - step, 0)], 0).astype(np.uint8)
            order = np.argsort(codes[last[active] - step + 1], kind="stable")  # new ones are by symbol, then as before
            active, new, before, going = active[order], new[order], before[order], going[order]
            files.write(self._merged(new, before, changed, shared))
            self.counts += np.bincount(before, minlength=256)
            active, place = active[going], new[going]

    def _places(self, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where the symbols before the suffixes at ``place`` (in order) make new positions, and the changed prefixes.

        Changed are new positions and those that follow one: with their common prefixes, in the order of positions.
        """
        smaller = self.n + np.cumsum(self.counts) - self.counts - self.counts[0]  # where a symbol's suffixes begin
        seen = np.zeros(256, np.int64)  # of each symbol in the chunks before
        least = np.zeros(256, np.uint8)  # of the common prefixes since its last one
        pending = np.zeros(256, bool)  # whether its last one makes a new position, so that its next one is changed
        new, changed, shared, kind_of, at = np.empty(len(place), np.int64), [], [], [], 0
        for symbol, common in self.files.read():
            size = len(symbol)
            lo, hi = np.searchsorted(place, (at, at + size))
            own = place[lo:hi] - at
            order = np.argsort(symbol, kind="stable")
            ranked = symbol[order]
            begin = np.searchsorted(ranked, np.arange(256, dtype=np.uint8))
            number = np.diff(np.append(begin, size))
            kinds = np.flatnonzero(number)
            shift = smaller + seen - begin  # from a rank in the chunk to a position
            is_own = np.zeros(size, bool)
            is_own[own] = True
            made = np.flatnonzero(is_own[order])  # the ranks of the chunk's own places, none of which has no symbol
            new[lo + np.argsort(symbol[own], kind="stable")] = made + shift[ranked[made]]
            # changed: the first of a symbol whose last one, in the chunks before, is a new position; then own places and what follows one
            first = begin[kinds[pending[kinds]]]
            both = np.stack([made, made + 1], axis=1)
            counts = np.ones(both.shape, bool)
            follows = np.minimum(made + 1, size - 1)
            counts[:, 1] = (follows > made) & (ranked[follows] == ranked[made]) & ~is_own[order[follows]]
            some = np.concatenate([first[~is_own[order[first]]], both[counts]])
            here = order[some]
            of = ranked[some]
            is_first = some == begin[of]
            start = np.where(is_first, 0, order[some - 1] + 1)
            value = np.empty(len(some), np.uint8)
            # ranges in falling order of their starts, so that nothing between two of them is looked at twice
            turn = np.argsort(start.astype(np.uint16) if size <= 1 << 16 else start, kind="stable")[::-1]
            bounds = np.stack([start[turn], here[turn] + 1], axis=1).ravel()
            padded = np.append(common, np.uint8(255))
            if len(some):
                value[turn] = np.minimum.reduceat(padded, bounds)[::2]
            value = np.where(is_first & (seen[of] > 0), np.minimum(value, least[of]), value)
            shared.append(np.where(is_first & (seen[of] == 0), 0, value + 1).astype(np.uint8))
            changed.append(some + shift[of])
            kind_of.append(of)
            ends = order[begin[kinds] + number[kinds] - 1]
            least = np.minimum(least, common.min())
            turn = np.argsort(ends)
            since = np.minimum.reduceat(padded, ends[turn] + 1)
            least[kinds[turn]] = np.minimum.accumulate(since[::-1])[::-1]
            pending[kinds] = is_own[ends]
            seen += number
            at += size
        order = np.argsort(np.concatenate(kind_of), kind="stable")
        return new, np.concatenate(changed)[order], np.concatenate(shared)[order]

    def _merged(self, new: np.ndarray, before: np.ndarray, changed: np.ndarray, shared: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """The current list with the new positions in it."""
        at, done = 0, 0
        rows_before = new - np.arange(len(new))  # of the current list
        total = self.counts.sum()
        for symbol, common in self.files.read():
            is_last = at + len(symbol) == total
            upto = len(new) if is_last else int(np.searchsorted(rows_before, at + len(symbol)))
            size = len(symbol) + upto - done
            where = new[done:upto] - at - done
            old = np.ones(size, bool)
            old[where] = False
            symbols, prefixes = np.empty(size, np.uint8), np.empty(size, np.uint8)
            symbols[where] = before[done:upto]
            symbols[old], prefixes[old] = symbol, common
            lo, hi = np.searchsorted(changed, (at + done, at + done + size))
            prefixes[changed[lo:hi] - at - done] = shared[lo:hi]  # all new positions are among them
            at += len(symbol)
            done = upto
            yield symbols, prefixes

    def read(self) -> tuple[np.ndarray, ...]:
        """The whole list: symbols and common prefixes."""
        return tuple(np.concatenate(x) for x in zip(*self.files.read(), strict=True))

    def walk(self, symbol: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length of suffix the texts that have one so long, and its positions."""
        order = np.argsort(symbol, kind="stable")[np.count_nonzero(symbol == 0) :]
        longer = np.zeros(len(symbol), np.int64)
        longer[order] = self.n + np.arange(len(order))
        texts, at = np.arange(self.n), np.arange(self.n)
        length = 0
        while len(texts):
            yield length, texts, at
            going = self.sizes[texts] > length
            texts, at, length = texts[going], longer[at[going]], length + 1


def least_owner(texts: list[bytes], owner: np.ndarray, files: ColumnFiles) -> np.ndarray:
    """For each string of LENGTH bytes, text by text: the least owner of a text that has it."""
    index = CollectionIndex(texts, files)
    symbol, common = index.read()
    group = np.cumsum(common < LENGTH) - 1
    strings = index.sizes - LENGTH + 1
    first = np.cumsum(strings) - strings
    of, owners = np.empty(strings.sum(), np.int64), np.repeat(owner, strings)
    for length, own, at in index.walk(symbol):
        if length >= LENGTH:
            of[first[own] + index.sizes[own] - length] = group[at]
    least = np.full(int(group[-1]) + 1, 2**63 - 1, np.int64)
    np.minimum.at(least, of, owners)
    return least[of]


PACKED = "p int, id long, slot int, keys binary, ids binary, slots binary, starts binary, sizes binary, data binary"
KINDS = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
NAMES = [x.split()[0] for x in PACKED.split(", ")]


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)


def by_document(ids: np.ndarray, slots: np.ndarray, values: np.ndarray, parts: int) -> Iterator[tuple]:
    """Rows for single documents: (p, id, slot, values)."""
    order = np.lexsort((slots, ids))
    ids, slots, values = ids[order], slots[order], values[order]
    at = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]) | (slots[1:] != slots[:-1])) + 1, [len(ids)]])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(ids[a]) % parts, int(ids[a]), int(slots[a]), values[a:b].tobytes()


def key_sender(parts: int):
    """From (id, slot, text): each block's keys with the least id that has them, dealt by key, and the block's repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, slots, texts in blocks(batches, BLOCK):
            keys, doc, _, _ = runs_of([t.encode() for t in texts])
            if not len(keys):
                continue
            ids, slots = np.array(ids, np.int64)[doc], np.array(slots, np.int32)[doc]
            order = np.lexsort((slots, ids, keys))
            keys, ids, slots = keys[order], ids[order], slots[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]) | (slots[1:] != slots[:-1])
            keys, ids, slots = keys[fresh], ids[fresh], slots[fresh]
            group = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            size = np.diff(np.append(group, len(keys)))
            least, most = np.repeat(ids[group], size), np.repeat(ids[group + size - 1], size)
            repeated = least < most
            rows = [(p, i, s, v, *[None] * 5) for p, i, s, v in by_document(ids[repeated], slots[repeated], keys[repeated], parts)] if repeated.any() else []
            first = ids == least
            keys, ids, slots = keys[first], ids[first], slots[first]
            part = (keys % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((ids, part))
            keys, ids, slots, part = keys[order], ids[order], slots[order], part[order]
            at = np.searchsorted(part, np.arange(parts + 1))
            rows += [(p, None, None, keys[a:b].tobytes(), ids[a:b].tobytes(), slots[a:b].tobytes(), None, None, None) for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
            yield packed_batch(rows)

    return run


def key_matcher(parts: int):
    """Of each dealt share of the keys: those that more than one id has, document by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped_rows(batches, 1):
            bounds = group_bounds(rows, 1)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                share = rows.slice(a, b - a)
                known = [(0, i, s, v) for i, s, v in zip(*(share.column(k).to_pylist() for k in (1, 2, 3)), strict=True) if i is not None]
                dealt = share.filter(pa.compute.is_valid(share.column(4)))
                if dealt.num_rows:
                    keys, ids, slots = (np.frombuffer(b"".join(dealt.column(k).to_pylist()), t) for k, t in ((3, np.uint64), (4, np.int64), (5, np.int32)))
                    order = np.lexsort((ids, keys))
                    keys, ids, slots = keys[order], ids[order], slots[order]
                    group = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                    size = np.diff(np.append(group, len(keys)))
                    repeated = np.repeat(ids[group] < ids[group + size - 1], size)
                    if repeated.any():
                        known += by_document(ids[repeated], slots[repeated], keys[repeated], parts)
                for lo in range(0, len(known), 20_000):
                    _, i, s, v = zip(*known[lo : lo + 20_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(s, pa.int32()), pa.array(v, pa.binary())], ["id", "slot", "keys"])

    return run


def run_sender(parts: int, most_known: int = 100_000):
    """From (id, slot, keys of a document, text): its runs with those keys, dealt by key; copies are settled at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for ids, slots, wanted, texts in blocks(batches, BLOCK):
            raw = [t.encode() for t in texts]
            keys, doc, start, count = runs_of(raw)
            bounds = np.searchsorted(doc, np.arange(len(raw) + 1))
            out: list[list[tuple]] = [[] for _ in range(parts)]
            rows = []
            if len(known) > most_known:
                known.clear()
            for d, (i, s, want) in enumerate(zip(ids, slots, wanted, strict=True)):
                a, b = bounds[d], bounds[d + 1]
                hit = a + np.flatnonzero(np.isin(keys[a:b], np.frombuffer(b"".join(want), np.uint64)))
                settled = []
                for k, at, n in zip(keys[hit].tolist(), start[hit].tolist(), count[hit].tolist(), strict=True):
                    data = raw[d][at : at + n + LENGTH - 1]
                    if known.setdefault(data, i) < i:
                        settled += (at, at + len(data))
                    else:
                        known[data] = i
                        out[k % parts].append((k, i, s, at, data))
                if settled:
                    rows.append((i % parts, i, s, None, None, None, np.array(settled, np.int64).tobytes(), None, None))
            for p, found in enumerate(out):
                if found:
                    k, i, s, at, data = zip(*found, strict=True)
                    arrays = (np.array(x, t).tobytes() for x, t in ((k, np.uint64), (i, np.int64), (s, np.int32), (at, np.int32), (list(map(len, data)), np.uint8)))
                    rows.append((p, None, None, *arrays, b"".join(data)))
            if rows:
                yield packed_batch(rows)

    return run


def settled_runs(keys, ids, slots, starts, texts: list[bytes], most_pieces: int, new_files) -> tuple[np.ndarray, ...]:
    """(id, slot, start, end) of the covered strings of these runs."""
    numbers: dict[bytes, int] = {}
    number = np.fromiter((numbers.setdefault(t, len(numbers)) for t in texts), np.int64, len(texts))
    distinct = list(numbers)
    owner, other = np.full(len(distinct), 2**63 - 1, np.int64), np.full(len(distinct), NO_ID, np.int64)
    np.minimum.at(owner, number, ids)
    np.maximum.at(other, number, ids)
    key_of = np.zeros(len(distinct), np.uint64)
    key_of[number] = keys
    order = np.flatnonzero(may_share(distinct, key_of, owner, other))
    # whole keys, by their longest runs: a collection has as many rounds as its longest run has bytes
    _, nth = np.unique(key_of[order], return_inverse=True)
    longest = np.zeros(len(order), np.int64)
    np.maximum.at(longest, nth, np.fromiter((len(distinct[x]) for x in order), np.int64, len(order)))
    turn = np.lexsort((nth, longest[nth]))
    order, nth = order[turn], nth[turn]
    group = np.flatnonzero(np.append(True, nth[1:] != nth[:-1]))
    members = np.argsort(number, kind="stable")
    member_at = np.searchsorted(number[members], np.arange(len(distinct) + 1))
    found, at = [(np.zeros(0, np.int64), np.zeros(0, np.int32), *(np.zeros(0, np.int64),) * 2)], 0
    while at < len(order):
        upto = np.searchsorted(group, at + most_pieces)  # whole keys
        end = int(group[upto]) if upto < len(group) else len(order)
        chosen, at = order[at:end], end
        files = new_files()
        least = least_owner([distinct[c] for c in chosen], owner[chosen], files)
        files.delete()
        strings = np.array([len(distinct[c]) for c in chosen]) - LENGTH + 1
        first = np.cumsum(strings) - strings
        # every run against its own strings' least owners, copies of it too
        counts = member_at[chosen + 1] - member_at[chosen]
        m = members[ranges(member_at[chosen], counts)]
        piece = np.repeat(np.arange(len(chosen)), counts)
        lost = least[ranges(first[piece], strings[piece])] < np.repeat(ids[m], strings[piece])
        hit = np.flatnonzero(lost)
        owner_row = np.repeat(np.arange(len(m)), strings[piece])[hit]
        begin = starts[m][owner_row] + ranges(np.zeros(len(m), np.int64), strings[piece])[hit]
        # strings that follow each other are one span
        new = np.ones(len(begin), bool)
        new[1:] = (owner_row[1:] != owner_row[:-1]) | (begin[1:] != begin[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(begin))[: len(head)] - 1
        own = m[owner_row[head]]
        found.append((ids[own], slots[own], begin[head], begin[tail] + LENGTH))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def run_settler(parts: int, most_pieces: int, folder: str, chunk: int):
    """Of each dealt share of the runs: the covered ranges, document by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_files = lambda: ColumnFiles(folder, chunk)
        for rows in grouped_rows(batches, 1):
            bounds = group_bounds(rows, 1)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                share = rows.slice(a, b - a)
                known = [(0, i, s, v) for i, s, v in zip(*(share.column(k).to_pylist() for k in (1, 2, 6)), strict=True) if i is not None]
                dealt = share.filter(pa.compute.is_valid(share.column(8)))
                if dealt.num_rows:
                    columns = [np.frombuffer(b"".join(dealt.column(k).to_pylist()), t) for k, t in ((3, np.uint64), (4, np.int64), (5, np.int32), (6, np.int32), (7, np.uint8))]
                    data = b"".join(dealt.column(8).to_pylist())
                    ends = np.cumsum(columns[4], dtype=np.int64).tolist()
                    texts = [data[x:y] for x, y in zip([0, *ends], ends, strict=False)]
                    ids, slots, begin, end = settled_runs(*columns[:3], columns[3].astype(np.int64), texts, most_pieces, new_files)
                    if len(ids):
                        known += by_document(ids, slots, np.stack([begin, end], axis=1), parts)
                for lo in range(0, len(known), 20_000):
                    _, i, s, v = zip(*known[lo : lo + 20_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(s, pa.int32()), pa.array(v, pa.binary())], ["id", "slot", "spans"])

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, is_copy, spans of a document, text): the maximal covered runs, and the other bytes joined."""
    for ids, copies, spans, texts in blocks(batches, BLOCK):
        rows = []
        for i, is_copy, own, text in zip(ids, copies, spans, texts, strict=True):
            data = text.encode()
            merged: list[list[int]] = [[0, len(data)]] if is_copy else []
            if own and not is_copy:
                pairs = np.unique(np.frombuffer(b"".join(own), np.int64).reshape(-1, 2), axis=0)
                reach = np.maximum.accumulate(pairs[:, 1])
                first = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
                merged = [list(x) for x in zip(pairs[first, 0].tolist(), reach[np.append(first[1:], len(pairs)) - 1].tolist(), strict=True)]
            kept, at = [], 0
            for start, end in merged:
                kept.append(data[at:start])
                at = end
            kept.append(data[at:])
            rows.append((None if i == NO_ID else i, len(data), sum(e - s for s, e in merged), len(merged), [{"start": s, "end": e} for s, e in merged], b"".join(kept)))
        kinds = [pa.int64()] * 4 + [SPANS, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def whole_copies(docs: DataFrame) -> DataFrame:
    """(id, slot) of documents of LENGTH bytes or more whose whole text a document with a smaller id has too."""
    slim = docs.filter(F.octet_length("text") >= LENGTH).select("id", "slot", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    first = slim.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last")
    return slim.join(first, ["h1", "h2"]).filter(F.col("id") > F.col("first")).select("id", "slot").distinct()


def suffix_dedup(documents: DataFrame, *, most_pieces: int = 20_000, chunk: int = 1 << 18) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_removed, n_spans, spans (byte ranges) and kept (the bytes that are left)."""
    spark = documents.sparkSession
    ship_package(spark)
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.hash(text).alias("slot"), text.alias("text"))
    # shares grow with the input: two for each of its splits, or as many as the session asks for
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())
    copies = cut_lineage(whole_copies(docs))
    own = docs.join(copies, ["id", "slot"], "left_anti")
    dealt = own.mapInArrow(key_sender(parts), PACKED).repartition(parts, "p").sortWithinPartitions("p")
    shared = dealt.mapInArrow(key_matcher(parts), "id long, slot int, keys binary")
    wanted = shared.groupBy("id", "slot").agg(F.collect_list("keys").alias("keys"))  # no more than a document's own runs
    runs = own.join(wanted, ["id", "slot"]).select("id", "slot", "keys", "text").mapInArrow(run_sender(parts), PACKED)
    folder = f"{shared_dir(spark)}/suffix-{uuid.uuid4().hex}"
    settled = runs.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(run_settler(parts, most_pieces, folder, chunk), "id long, slot int, spans binary")
    spans = settled.groupBy("id", "slot").agg(F.collect_list("spans").alias("spans"))
    every = docs.join(spans, ["id", "slot"], "left").join(copies.withColumn("is_copy", F.lit(True)), ["id", "slot"], "left")
    return every.select("id", F.coalesce("is_copy", F.lit(False)).alias("is_copy"), "spans", "text").mapInArrow(removed, RESULT)


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
