"""Suffix-array dedup: long matches found by streaming texts through run-length indexes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bundles import BUCKET_BYTES, BUNDLE_BYTES, bucket_count, bucket_of, bundled, cut_up, pack, ranks, rows_of, unpack
from .shared import discard, stored

#: Bytes of the shortest runs by which windows are dealt out.
SEED_BYTES = 20
#: Most windows in one piece of text.
PIECE_WINDOWS = 256
#: Most pieces of one seed that are indexed together; those of seeds with more are dealt out again by longer runs.
LARGE_SEED = 4096
#: Bytes of pieces in one index (small enough for a processor's cache), a few more for the last seed.
INDEX_BYTES = 1 << 18
#: Long texts are cut to pieces by so many bytes at a time.
STEP_BYTES = 1 << 18

#: Letters that one index can number.
INDEX_BITS = 21

_MIX, _POWER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def seed_hashes(raw: np.ndarray, size: int = SEED_BYTES) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes (8 or more), from the 8-byte words in it."""
    words = _words(raw)
    n = len(raw) - size + 1
    h = words[:n] * _MIX
    h ^= h >> np.uint64(29)
    for at in range(8, size, 8):
        at = min(at, size - 8)
        h = (h ^ words[at : at + n]) * _MIX
        h ^= h >> np.uint64(32)
    return h


def _words(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, the first byte highest."""
    words = raw.astype(np.uint64)
    for shift in (1, 2, 4):
        words = (words[:-shift] << np.uint64(8 * shift)) | words[shift:]
    return words


def pieces(raws: list[bytes], window: int, size: int = SEED_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, seed, start, end): the texts as overlapping pieces such that each window of ``window`` bytes is whole in exactly one.

    A window's seed is the least hash of the runs of ``size`` bytes in it, so equal windows have equal seeds wherever they are;
    neighbours of one seed share a piece. Texts shorter than a window have none. Long texts go through in steps.
    """
    out, group, held = [], [], 0
    for i, raw in enumerate(raws):
        for at in range(0, len(raw) - window + 1, STEP_BYTES):
            part = raw[at : at + STEP_BYTES + window - 1]
            group.append((i, at, part))
            held += len(part)
            if held >= STEP_BYTES:
                out.append(_pieces(group, window, size))
                group, held = [], 0
    out.append(_pieces(group, window, size))
    return tuple(map(np.concatenate, zip(*out)))


def _pieces(group: list[tuple[int, int, bytes]], window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for *_, x in group], np.int64)
    ends = lengths.cumsum()
    if not group:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, span, runs = seed_hashes(np.frombuffer(b"".join([x for *_, x in group]), np.uint8), size), 1, window - size + 1
    while 2 * span <= runs:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < runs:
        least = np.minimum(least[: len(least) - (runs - span)], least[runs - span :])
    n = len(least)
    whole = np.arange(window, window + n) <= np.repeat(ends, lengths)[:n]  # windows within one text
    begins = whole.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~whole[:-1]
    goes_on = np.zeros(n, bool)
    goes_on[:-1] = whole[1:] & ~begins[1:]
    start, stop = np.flatnonzero(begins), np.flatnonzero(whole & ~goes_on) + 1
    if len(start) and (stop - start).max() > PIECE_WINDOWS:
        n_parts = -(-(stop - start) // PIECE_WINDOWS)
        part = np.arange(n_parts.sum()) - np.repeat(n_parts.cumsum() - n_parts, n_parts)
        start, stop = np.repeat(start, n_parts) + part * PIECE_WINDOWS, np.repeat(stop, n_parts)
        stop = np.minimum(stop, start + PIECE_WINDOWS)
    which = np.searchsorted(ends, start, side="right")
    shift = (np.array([at for _, at, _ in group], np.int64) - (ends - lengths))[which]
    seed = least[start] * _MIX  # least hashes are small numbers; spread over all buckets they stay distinct
    return np.array([i for i, *_ in group], np.int64)[which], seed ^ (seed >> np.uint64(32)), start + shift, stop + window - 1 + shift


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of strings, to stream other strings through.

    Per run of equal letters: where it starts, its letter, where its first suffix goes when the letter is put before it (so a step back is
    a look-up and an addition), and as samples the places in the text of the suffixes at its two ends. At the borders
    where suffixes stop to agree over ``window`` letters: the smallest owner on the stretch. The suffix array is only there
    while the index is built.
    """

    def __init__(self, strings: list[bytes], owners: np.ndarray, window: int) -> None:
        self.window = window
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        ends = (lengths + 1).cumsum()
        # letters are 1 to 256 and each string ends with 0, which sorts by string
        text = np.zeros(int(ends[-1]), np.int64)
        body = np.ones(len(text), bool)
        body[ends - 1] = False
        text[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        order, agree = _suffix_array(text, window)
        before = text[order - 1]  # before the first string's start: the last end, 0
        change = np.concatenate([[True], before[1:] != before[:-1]])
        ends_here = np.flatnonzero(before == 0)  # runs of one: each end is its own string's
        change[ends_here] = True
        change[ends_here[ends_here + 1 < len(before)] + 1] = True
        place = np.empty(len(text), np.int64)
        place[order] = np.arange(len(text))
        self.starts = np.flatnonzero(change)
        self.stops = np.append(self.starts[1:], len(text)) - 1
        self.letters = before[self.starts]
        self.to = place[order[self.starts] - 1]  # from a string's start it goes nowhere that is read
        self.sampled = order[self.starts], order[self.stops]
        self.borders = np.flatnonzero(~agree)
        self.least = np.minimum.reduceat(np.repeat(owners, lengths + 1)[order], self.borders)
        self.words = _words(np.concatenate([np.where(body, text - 1, 0).astype(np.uint8), np.zeros(window + 16, np.uint8)]))
        self.left = np.repeat(ends - 1, lengths + 1) - np.arange(len(text))  # letters to a string's end
        by = np.lexsort((np.arange(len(self.starts)), self.letters))
        self.runs_by_letter, self.key = by, self.letters[by] * len(by) + by

    def stream(self, strings: list[bytes], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(string, offset) of each window of the strings that also stands in an indexed string of a smaller owner than ``own``.

        All strings are read backwards, one letter of each at a time, and keep their matching statistics: the row of a suffix that
        agrees best with what was read, and how many letters agree, up to ``window``. Where the next letter is not the one of the
        row's run, the nearest runs of that letter above and below offer their ends; the samples tell where these stand in
        the text, which tells how far they agree.
        """
        window, runs = self.window, len(self.starts)
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        raw = np.concatenate([np.frombuffer(b"".join(strings), np.uint8), np.zeros(window + 16, np.uint8)])
        read, words = raw.astype(np.int64) + 1, _words(raw)
        alive = np.arange(len(strings))
        at = lengths.cumsum()  # what was read starts here
        row, agree = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64)
        found_s, found_o = [], []
        for step in range(1, int(lengths.max(initial=0)) + 1):
            more = lengths[alive] >= step
            if not more.all():
                alive, at, row, agree = alive[more], at[more], row[more], agree[more]
            letter = read[at - 1]
            run = np.searchsorted(self.starts, row, side="right") - 1
            off = np.flatnonzero(self.letters[run] != letter)
            if len(off):
                wanted = letter[off]
                k = np.searchsorted(self.key, wanted * runs + run[off])
                best, best_run, best_row = np.full(len(off), -1), np.zeros(len(off), np.int64), np.zeros(len(off), np.int64)
                for side, rows, sample in ((0, self.starts, self.sampled[0]), (-1, self.stops, self.sampled[1])):
                    near = self.runs_by_letter[np.clip(k + side, 0, runs - 1)]
                    some = np.flatnonzero(self.letters[near] == wanted)
                    near = near[some]
                    length = self._agreement(words, at[off[some]], sample[near], agree[off[some]])
                    better = length > best[some]
                    some, near = some[better], near[better]
                    best[some], best_run[some], best_row[some] = length[better], near, rows[near]
                run[off], row[off], agree[off] = best_run, best_row, best
            row = np.where(agree >= 0, self.to[run] + row - self.starts[run], 0)
            agree = np.minimum(agree + 1, window)  # a letter that stands nowhere: -1 before, nothing agrees
            at = at - 1
            if step >= window:
                full = np.flatnonzero(agree == window)
                stretch = np.searchsorted(self.borders, row[full], side="right") - 1
                match = alive[full[self.least[stretch] < own[alive[full]]]]
                found_s.append(match)
                found_o.append(lengths[match] - step)
        none = [np.zeros(0, np.int64)]
        return np.concatenate(found_s or none), np.concatenate(found_o or none)

    def _agreement(self, words: np.ndarray, at: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many letters from ``at`` in what is streamed agree with the text from ``place`` on, ``most`` at most."""
        most = np.minimum(most, self.left[place])
        out, on = np.zeros(len(at), np.int64), np.arange(len(at))
        for done in range(0, self.window, 8):
            on = on[most[on] > done]
            if not len(on):
                break
            differ = words[at[on] + done] ^ self.words[place[on] + done]
            top = (differ & ~(differ >> np.uint64(1))).astype(np.float64)  # the highest bit that differs, safe from rounding up
            out[on] = done + (64 - np.frexp(top)[1]) // 8
            on = on[differ == 0]
        return np.minimum(out, most)


def _suffix_array(text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes of strings that end with 0 (the zeros in order of their strings), and whether each suffix agrees with
    the one before it over ``window`` letters. By doubling, only over suffixes that still tie; what is sorted has its place in its low bits."""
    n, bits = len(text), INDEX_BITS
    if n >> bits:
        raise ValueError(f"an index holds less than {1 << bits} letters")
    places, low = np.arange(n), (1 << bits) - 1
    # four letters at once; nothing counts after an end, and suffixes that end within them stay in order of their strings
    key, alive, width = np.zeros(n, np.int64), np.ones(n, bool), 4
    for k in range(width):
        letter = np.where(alive, np.concatenate([text[k:], np.zeros(k, np.int64)]), 0)
        key = key * 257 + letter
        alive &= letter > 0
    packed = np.sort((key << bits) | places)
    order, key = packed & low, packed >> bits
    head = np.concatenate([[True], key[1:] != key[:-1]]) | ~alive[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, places, 0))  # the place of the first suffix that ties
    level, level_width = rank.copy(), width
    while True:
        tied = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))
        if not len(tied):
            break
        own = order[tied]
        after = np.where(own + width < n, rank[np.minimum(own + width, n - 1)], 0)
        packed = np.sort((rank[own] << (2 * bits)) | (after << bits) | own)
        own, both = packed & low, packed >> bits
        order[tied] = own
        new = np.concatenate([[True], both[1:] != both[:-1]])
        head[tied] = new
        rank[own] = np.maximum.accumulate(np.where(new, tied, 0))
        width *= 2
        if width <= window:
            level, level_width = rank.copy(), width
    # agreement over the window: stretches of the widest level within it
    agree = np.zeros(n, bool)
    prev, here = order[:-1], order[1:]
    same = np.ones(max(0, n - 1), bool)
    for off in [*range(0, window - level_width, level_width), window - level_width]:
        same &= (here + off < n) & (prev + off < n)
        same &= level[np.minimum(here + off, n - 1)] == level[np.minimum(prev + off, n - 1)]
    agree[1:] = same
    return order, agree


def find_repeats(strings: list[bytes], owners: np.ndarray, window: int, groups: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
    """Per string the bytes that are covered by windows which also stand in a string with a smaller owner, as runs (start, size).

    Strings only match within their group. So those of the greatest owner of a group need no index, and those of the smallest
    are not streamed: of two strings, the one is the index and the other streams through it.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    group = np.zeros(len(strings), np.int64) if groups is None else np.unique(groups, return_inverse=True)[1]
    first, last = np.full(len(strings), np.iinfo(np.int64).max), np.full(len(strings), -1)
    np.minimum.at(first, group, owners)
    np.maximum.at(last, group, owners)
    held, read = np.flatnonzero(owners < last[group]), np.flatnonzero(owners > first[group])
    if len(held) and len(read):
        s, o = RunLengthIndex([strings[i] for i in held.tolist()], owners[held], window).stream([strings[i] for i in read.tolist()], owners[read])
        at = np.lexsort((o, s))
        s, o = read[s[at]], o[at]
        opens = np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] > o[:-1] + window)]) if len(s) else np.zeros(0, bool)
        begin = np.flatnonzero(opens)
        end = np.concatenate([begin[1:], [len(s)]])[: len(begin)] - 1
        for i, a, z in zip(s[begin].tolist(), o[begin].tolist(), (o[end] + window).tolist()):
            out[i].append((a, z - a))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, bundle_bytes: int = BUNDLE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: id, kept (binary: the bytes that stay), n_bytes, n_removed, spans (array of start, end: the maximal runs removed).

    A byte goes if a string of ``window`` bytes over it also starts in a row with a smaller id. Exact, and judged on the input.
    1. Rows are packed to bundles of about ``bundle_bytes``, stored; what follows combines within a bundle before it is shuffled.
    2. Every text is cut into pieces by its windows' seeds (``pieces``). The distinct seeds of all bundles meet in buckets, which answer
       for each whether other rows have it too, a byte each: the rest of a text can't match.
    3. The distinct pieces of the seeds that recur, each with its smallest id in the bundle, meet in buckets. Equal pieces need no
       comparison: all but the first lose all. Different pieces of a seed go to run-length indexes (``RunLengthIndex``), and
       those of greater ids stream through: windows that stand in a piece with a smaller id go.
    4. The answers return to their bundles, whose texts are reassembled.
    A seed with more than ``LARGE_SEED`` different pieces, or more letters in them than an index numbers (a phrase that many texts embed in different words) is more than one task
    should hold: its pieces are dealt out again, the same way, by longer runs, at last by whole windows, whose pieces are all equal.
    A bucket thus holds a bounded share of the texts, and of what all texts share one copy per bundle.

    Null and empty texts stay as they are (0 bytes). Rows with a null id are kept whole and match nothing. Rows that repeat
    an id don't match each other, only smaller ids. Only the id and text columns are read. An empty table gives an empty table.
    """
    if window < SEED_BYTES:
        raise ValueError(f"windows have at least {SEED_BYTES} bytes")
    kind = docs.schema[id_col].dataType
    bundles = bundled(docs, id_col, text_col, bundle_bytes)
    buckets = bucket_count(bundles, bucket_bytes)
    gone = _spans(bundles, kind, window, buckets, sorted({SEED_BYTES, (SEED_BYTES + window) // 2, window}))
    result = T.StructType([T.StructField(id_col, kind), T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    return bundles.join(gone, "bundle", "left").select("ids", "sizes", "z", "s", "a", "e").mapInArrow(_reassemble(id_col), result)


_SPANS = "bundle long, s binary, a binary, e binary"


def _spans(bundles: DataFrame, kind: T.DataType, window: int, buckets: int, sizes: list[int]) -> DataFrame:
    """(bundle, s, a, e): the spans of each bundle's strings that go, as string, start and end; stored."""
    size, last = sizes[0], len(sizes) == 1
    # pieces have fewer letters than this, so an index holds what came before a seed, and the seed
    most = max(1, min(LARGE_SEED, ((1 << INDEX_BITS) - INDEX_BYTES) // (PIECE_WINDOWS + window + 1) - 1))

    def seeds(batches):
        for batch in batches:
            for bundle, ids, lengths, z in rows_of(batch, "bundle", "ids", "sizes", "z"):
                owner, raws = _strings(ids, lengths, z)
                text, h, start, end = pieces(raws, window, size)
                u, n, several = _seeds(h, owner[text], _piece_hashes(raws, text, start, end))
                cut = np.searchsorted(bucket_of(u, buckets), np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    own = slice(cut[b], cut[b + 1])
                    yield pa.RecordBatch.from_arrays([pa.array([bundle]), pa.array([b], pa.int32()), _binary([u[own]]), _binary([n[own].astype("<u2") | (several[own].astype("<u2") << 15)])], names=["bundle", "bucket", "h", "n"])

    def judge(table: pa.Table) -> pa.Table:
        h, n = _numbers(table, "h", np.uint64), _numbers(table, "n", "<u2")
        u, which = np.unique(h, return_inverse=True)
        bundles_with, several = np.bincount(which), np.bincount(which, n >> 15)
        answer = ((bundles_with > 1) | (several > 0)).astype(np.uint8)
        if not last:
            answer[(answer > 0) & (np.bincount(which, n & 0x7FFF) > most)] = 2
        ends = np.cumsum([x.as_buffer().size // 8 for x in table.column("h")])
        flags = [pack(x.tobytes()) for x in np.split(answer[which], ends[:-1])]
        return pa.table([table.column("bundle"), table.column("bucket"), pa.array(flags, pa.binary())], names=["bundle", "bucket", "flags"])

    judged = bundles.mapInArrow(seeds, "bundle long, bucket int, h binary, n binary").groupBy("bucket").applyInArrow(judge, "bundle long, bucket int, flags binary")
    judged = stored(judged, "seeds")
    flags = judged.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("bucket", "flags")))["flags"].alias("flags"))

    def cut(batches):
        """Bucket 0 and above: distinct pieces (owner, seed, size, bytes); -1: where the pieces are (string, start, piece, is it of the
        smallest owner); -2: crowded pieces. Pieces are numbered in this order: buckets, then crowded ones."""
        for batch in batches:
            for bundle, ids, lengths, z, flags in rows_of(batch, "bundle", "ids", "sizes", "z", "flags"):
                owner, raws = _strings(ids, lengths, z)
                text, h, start, end = pieces(raws, window, size)
                flag = np.frombuffer(b"".join(map(unpack, flags)), np.uint8)[np.unique(h, return_inverse=True)[1]]
                hit = np.flatnonzero(flag)
                text, h, start, end, flag = text[hit], h[hit], start[hit], end[hit], flag[hit]
                if not len(hit):
                    continue
                number: dict[bytes, int] = {}
                which = np.fromiter((number.setdefault(raws[i][a:e], len(number)) for i, a, e in zip(text.tolist(), start.tolist(), end.tolist())), np.int64, len(text))
                some = np.zeros(len(number), np.int64)
                some[which[::-1]] = np.arange(len(which))[::-1]  # one place of each piece
                least = np.full(len(number), np.iinfo(np.int64).max)
                np.minimum.at(least, which, owner[text])
                bucket = np.where(flag[some] == 1, bucket_of(h[some], buckets), buckets)
                order = np.lexsort((h[some], bucket))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                strings, holder = list(number), np.zeros(owner.max() + 1, np.int64)
                holder[owner[owner >= 0]] = np.flatnonzero(owner >= 0)  # a string of each owner
                own = ids.take(pa.array(holder[least[order]]))
                edge = np.searchsorted(bucket[order], np.arange(buckets + 2))
                for b in np.flatnonzero(np.diff(edge)).tolist():
                    here = order[edge[b] : edge[b + 1]]
                    body = [strings[i] for i in here.tolist()]
                    yield _row(bundle, b if b < buckets else -2, pa.ListArray.from_arrays([0, len(here)], own.slice(edge[b], len(here))), h[some[here]].tobytes(), np.array([len(x) for x in body], "<i4").tobytes(), pack(b"".join(body)))
                places = np.stack([text, start, rank[which], end - start, owner[text] == least[which]]).astype("<i4")
                yield _row(bundle, -1, pa.array([None], pa.list_(ids.type)), np.array([edge[buckets]], "<i8").tobytes(), b"", pack(places.tobytes()))

    schema = T.StructType([T.StructField("bundle", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("h", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("z", T.BinaryType())])
    found = stored(bundles.join(flags, "bundle").select("bundle", "ids", "sizes", "z", "flags").mapInArrow(cut, schema), "pieces")
    discard(judged)

    def match(table: pa.Table) -> pa.Table:
        owner = ranks(pa.concat_arrays([x.values for x in table.column("ids")]))
        h, length = _numbers(table, "h", np.uint64), _numbers(table, "sizes", "<i4")
        raw, stop = b"".join([unpack(x.as_py()) for x in table.column("z")]), length.cumsum()
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(raw[e - n : e], len(number)) for n, e in zip(length.tolist(), stop.tolist())), np.int64, len(length))
        strings, seed = list(number), np.zeros(len(number), np.uint64)
        seed[which] = h
        first = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(first, which, owner)
        spans = _indexed(strings, first, seed, window)
        rows = []
        ends = np.cumsum([len(x) for x in table.column("ids")])
        for at in np.split(np.arange(len(which)), ends[:-1]):
            whole = owner[at] > first[which[at]]
            part = [(i, a, a + n) for i, k in enumerate(which[at].tolist()) if not whole[i] for a, n in spans.get(k, ())]
            rows.append((len(at), np.packbits(whole).tobytes(), pack(np.array(part, "<i4").reshape(-1, 3).tobytes())))
        n, whole, part = zip(*rows)
        return pa.table([table.column("bundle"), table.column("bucket"), pa.array(n, pa.int32()), pa.array(whole, pa.binary()), pa.array(part, pa.binary())], names=["bundle", "bucket", "n", "whole", "part"])

    matched = found.where("bucket >= 0").groupBy("bucket").applyInArrow(match, "bundle long, bucket int, n int, whole binary, part binary")
    answers = matched.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "whole", "part"))).alias("answers"))
    places = found.where("bucket = -1").select("bundle", F.col("h").alias("normal"), F.col("z").alias("places")).join(answers, "bundle", "left")
    crowded = found.where("bucket = -2").select("bundle", "ids", "sizes", "z")
    if not last and crowded.limit(1).count():
        places = places.join(_spans(crowded, kind, window, buckets, sizes[1:]), "bundle", "left")
    else:
        places = places.selectExpr("*", *(f"cast(null as binary) as {c}" for c in "sae"))

    def lost(batches):
        for batch in batches:
            for bundle, normal, z, answers, s, a, e in rows_of(batch, "bundle", "normal", "places", "answers", "s", "a", "e"):
                text, start, piece, length, least = np.frombuffer(unpack(z), "<i4").reshape(5, -1).astype(np.int64)
                normal, pieces_of = int(np.frombuffer(normal, "<i8")[0]), int(piece.max()) + 1
                whole, parts_of = [np.zeros(0, bool)], [np.zeros((0, 3), np.int64)]
                base = 0
                for x in answers or ():
                    whole.append(np.unpackbits(np.frombuffer(x["whole"], np.uint8), count=x["n"]).astype(bool))
                    parts_of.append(np.frombuffer(unpack(x["part"]), "<i4").reshape(-1, 3) + [base, 0, 0])
                    base += x["n"]
                if s is not None:
                    parts_of.append(np.stack([np.frombuffer(x, "<i4").astype(np.int64) for x in (s, a, e)], 1) + [normal, 0, 0])
                whole = np.concatenate([*whole, np.zeros(pieces_of, bool)])[:pieces_of]
                part = np.concatenate(parts_of)
                part = part[np.argsort(part[:, 0], kind="stable")]
                all_gone = (least == 0) | whole[piece]
                got = [(text[all_gone], start[all_gone], (start + length)[all_gone])]
                own = np.flatnonzero(~all_gone)
                low, high = np.searchsorted(part[:, 0], piece[own]), np.searchsorted(part[:, 0], piece[own], side="right")
                n = high - low
                own, row = np.repeat(own, n), np.repeat(low - (n.cumsum() - n), n) + np.arange(n.sum())
                got.append((text[own], start[own] + part[row, 1], start[own] + part[row, 2]))
                s, a, e = (np.concatenate(x).astype("<i4").tobytes() for x in zip(*got))
                if s:
                    yield pa.RecordBatch.from_arrays([pa.array([bundle]), *(pa.array([x], pa.binary()) for x in (s, a, e))], names=["bundle", "s", "a", "e"])

    out = stored(places.select("bundle", "normal", "places", "answers", "s", "a", "e").mapInArrow(lost, _SPANS), "lost")
    discard(found)
    return out


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def _numbers(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _row(bundle: int, bucket: int, ids: pa.Array, *raw: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bundle]), pa.array([bucket], pa.int32()), ids, *(pa.array([x], pa.binary()) for x in raw)], names=["bundle", "bucket", "ids", "h", "sizes", "z"])


def _strings(ids: pa.Array, lengths: bytes, z: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Each string's rank of owner and its bytes; those without an owner are empty."""
    owner = ranks(ids)
    return owner, [x if o >= 0 else b"" for x, o in zip(cut_up(unpack(z), lengths), owner.tolist())]


def _piece_hashes(raws: list[bytes], text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each whole piece, by which different pieces of a seed are counted: a polynomial in the place of its bytes, as a difference of sums up to its ends."""
    raw = np.frombuffer(b"".join(raws), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(x) for x in raws])]).astype(np.int64)[text]
    powers = np.full(len(raw) + 1, _POWER)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _MIX * powers[:-1])])
    a, z = base + start, base + end
    # times the power of what lies behind the piece's start, all pieces are at the same place
    return (sums[z] - sums[a]) * powers[len(raw) - a] ^ (end - start).astype(np.uint64)


def _seeds(h: np.ndarray, owner: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, number of different pieces, has it several owners) per distinct seed, in order."""
    order = np.lexsort((whole, h))
    h, owner, whole = h[order], owner[order], whole[order]
    opens = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    if not len(opens):
        return h, np.zeros(0, np.int64), np.zeros(0, bool)
    other = np.concatenate([[1], (h[1:] != h[:-1]) | (whole[1:] != whole[:-1])]).astype(np.int64)
    return h[opens], np.minimum(np.add.reduceat(other, opens), 0x7FFF), np.minimum.reduceat(owner, opens) != np.maximum.reduceat(owner, opens)


def _indexed(strings: list[bytes], owners: np.ndarray, seeds: np.ndarray, window: int) -> dict[int, list[tuple[int, int]]]:
    """Runs of each string that goes in part, from indexes over the strings of many seeds; a string that is its seed's only one needs none."""
    order = np.argsort(seeds, kind="stable")
    sorted_seeds = seeds[order]
    edges = np.append(np.flatnonzero(np.concatenate([[True], sorted_seeds[1:] != sorted_seeds[:-1]])), len(order)) if len(order) else np.zeros(1, np.int64)
    out: dict[int, list[tuple[int, int]]] = {}
    batch: list[int] = []
    held = 0
    for a, z in zip(edges.tolist(), edges[1:].tolist()):
        if z - a > 1:
            batch += order[a:z].tolist()
            held += sum(len(strings[i]) + 1 for i in order[a:z].tolist())
        if held > INDEX_BYTES or z == len(order):
            found = find_repeats([strings[i] for i in batch], owners[batch], window, seeds[batch])
            out |= {i: x for i, x in zip(batch, found) if x}
            batch, held = [], 0
    return out


def _merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Spans as maximal runs (start, end)."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    opens = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return list(zip(start[opens].tolist(), end[np.append(opens[1:], len(start)) - 1].tolist()))


def _reassemble(id_col: str):
    """Bundles with their spans back to rows."""

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for ids, lengths, z, s, a, e in rows_of(batch, "ids", "sizes", "z", "s", "a", "e"):
                raw, length = unpack(z), np.frombuffer(lengths, "<i4").astype(np.int64)
                s, a, e = (np.frombuffer(x or b"", "<i4") for x in (s, a, e))
                order = np.argsort(s, kind="stable")
                edge = np.searchsorted(s[order], np.arange(len(length) + 1))
                stops = length.cumsum().tolist()
                for low in range(0, len(length), 256):
                    kept, spans = [], []
                    for i in range(low, min(low + 256, len(length))):
                        text = raw[stops[i] - int(length[i]) : stops[i]]
                        here = order[edge[i] : edge[i + 1]]
                        runs = _merged(a[here], e[here]) if len(here) else []
                        at, left = 0, []
                        for x, y in runs:
                            left.append(text[at:x])
                            at = y
                        left.append(text[at:])
                        kept.append(b"".join(left))
                        spans.append([{"start": x, "end": y} for x, y in runs])
                    n = length[low : low + 256]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(low, len(kept)), pa.array(kept, pa.binary()), pa.array(n), pa.array(n - [len(x) for x in kept]), pa.array(spans, kind)],
                        names=[id_col, "kept", "n_bytes", "n_removed", "spans"],
                    )

    return run
