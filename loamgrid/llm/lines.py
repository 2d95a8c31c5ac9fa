"""Fuzzy line deduplication.

Lines are normalised (lower case, digits as 0, words only) and two are similar
if at most one in five of the longer one's words must be edited. Candidates
share a run of words. Of a line of n words, at most n // 5 edits leave one of
n // 5 + 1 pieces whole, by the pigeonhole principle, so up to PIECED words the
pieces of one line are sought in the other. Of longer lines the SAMPLE runs of
three words with the least hashes are compared. Candidates whose sets of words,
or SimHashes if they are long, differ too much are dropped, and the edit
distance of the words decides. Of each group of lines connected by equality or
similarity one occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import table
from loamgrid.llm.linewords import line_words, mixed, normal, run_hashes, words_of
from loamgrid.llm.linking import compact, linked_components, sized, spread, spread_wide
from loamgrid.operators.components import connected_components
from loamgrid.session import durable

#: Lines are similar if at most one in so many words of the longer one must be edited.
EDITS = 5
#: Words up to which a line's pieces are sought in all places; longer lines have a sample of runs instead.
PIECED = 20
#: Words of a shared piece, at most; words of a sampled run, and runs sampled.
PIECE, RUN, SAMPLE = 4, 3, 10
#: Lines of up to so many words are told apart by 128 bits that mark their words, which loses none; longer ones by a SimHash.
SET_WORDS = 120
#: Bits of 128 in which SimHashes of similar lines may differ: 36 are expected at one replaced word in five, with a deviation of 5.
RADIUS = 46
#: Bits that mark a candidate line's words.
SET_BITS = 1024
#: Lines of a run whose pairs are all tested, and may all become edges; more are searched breadth first, in so many tests a line.
PAIRS_UP_TO, TESTS = 8, 4000
#: Shares of the difference that similar lines may have, at which the lines of a run are connected, one after the other.
CLOSE = (0.5, 1.0)
#: Words in a block of exact comparisons; characters of text whose lines are taken up together; rows that become Python values at once.
BLOCK_WEIGHT, FLUSH, SLICE = 500_000, 700_000, 100
#: For each byte, its bits, the first most significant, as eight bytes in one number.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def simhashes(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit SimHashes of consecutive groups of hashes that begin at ``starts``.

    Votes are summed eight bits at a time, in bytes of one number each, over
    pieces of up to 255 hashes, and then over a group's pieces.
    """
    sizes = np.diff(np.append(starts, len(ids)))
    pieces = (sizes + 254) // 255
    firsts = np.cumsum(pieces) - pieces
    piece_starts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(firsts, pieces))
    lanes = LANES[ids.astype(">u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, piece_starts, axis=0).view(np.uint8).reshape(-1, 64)
    votes = np.add.reduceat(sums, firsts, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


class Lines:
    """The lines with a word of some texts: ``ids`` of all words, and for each line its start, size, key and place."""

    def __init__(self, texts: list[str | None]):
        self.ids, line, of_text = words_of([normal(t or "") for t in texts])
        at = np.flatnonzero(np.diff(line, prepend=-1))
        self.starts, self.size = at, np.diff(np.append(at, len(self.ids)))
        self.key = run_hashes(self.ids, at, at + self.size).view(np.int64)
        self.text = np.repeat(np.arange(len(texts)), of_text)[line[at]]
        self.line_no = line[at] - (np.cumsum(of_text) - of_text)[self.text]


def flushes(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    """The rows of ``batches``, some at a time, so that the texts of ``column`` are of a bounded size or one text."""
    rows, size = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            for row in batch.slice(k, SLICE).to_pylist():
                rows.append(row)
                size += len(row[column] or "") + 50
                if size > FLUSH:
                    yield rows
                    rows, size = [], 0
    if rows:
        yield rows


def piece_size(n: int) -> int:
    """Words that each of the n // EDITS + 1 pieces of a line of n words has at least, up to PIECE."""
    return min(PIECE, n // (n // EDITS + 1))


def sizes_sought(m: int) -> set[int]:
    """The sizes of pieces of all lines of m to PIECED words that a line of m words may be similar to."""
    return {piece_size(n) for n in range(m, PIECED + 1) if n - n // EDITS <= m}


#: For each size of a piece and number of words, whether pieces of it are sought, and whether the line's own pieces have it.
SOUGHT = {k: np.array([m >= EDITS and k in sizes_sought(m) for m in range(PIECED + 1)]) for k in range(2, PIECE + 1)}
OWN = {k: np.array([m >= EDITS and k == piece_size(m) for m in range(PIECED + 1)]) for k in range(2, PIECE + 1)}


def reaches(n: int) -> int:
    """Words from which a line may be similar to one of more than n words."""
    return n + 1 - (n + 1) // EDITS


def runs_of(ids: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the runs of ``words`` words that begin at each place, across lines too."""
    run = ids
    for k in range(1, words):
        run = (run[:-1] ^ (run[:-1] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k:] if len(run) > 1 else run[:0]
    return mixed(run + np.uint64(words))


def pieces(ids: np.ndarray, starts: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, line, far, own) of the runs of words that lines share with similar ones; if ``exact``, the pieces of lines of any length.

    ``ids`` are the hashes of the words of lines that begin at ``starts``.
    ``own`` marks the pieces of a line itself and sampled runs; the rest are
    only sought in it. ``far`` marks the sampled runs that lead to lines of more
    than SET_WORDS words; runs of one kind meet no other kind.
    """
    n = np.diff(np.append(starts, len(ids)))
    found = whole_pieces(*some_lines(ids, n, (n <= PIECED) | exact), exact)
    if exact:
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    run, line, n_of = least_runs(*some_lines(ids, n, n >= reaches(PIECED)))
    for far, some in ((False, n_of <= SET_WORDS), (True, n_of >= reaches(SET_WORDS))):
        found.append((mixed(run[some] ^ np.uint64(0x5851F42D4C957F2D + far)), line[some], np.full(some.sum(), far), np.ones(some.sum(), bool)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def some_lines(ids: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, line, place, size) of the words of the ``wanted`` lines."""
    size = n[wanted]
    starts = np.cumsum(size) - size
    return ids[np.repeat(wanted, n)], np.repeat(np.flatnonzero(wanted), size), np.arange(size.sum()) - np.repeat(starts, size), np.repeat(size, size)


def whole_pieces(ids: np.ndarray, line: np.ndarray, place: np.ndarray, size: np.ndarray, exact: bool = False) -> list[tuple]:
    """The pieces of lines and the runs in which those of similar lines are sought, of up to PIECED words or, if ``exact``, of any number."""
    number = size // EDITS + 1
    no = -(-place * number // size)
    first = (no < number) & (no * size // number == place)
    found = []
    for k in range(2, PIECE + 1):
        run = runs_of(ids, k)
        fits = slice(len(run))
        # From 19 words on pieces are of PIECE words, whatever the length.
        sought = (SOUGHT[k] | (np.arange(PIECED + 1) >= reaches(PIECED)) & (k == PIECE)) if exact else SOUGHT[k]
        at = np.flatnonzero((place[fits] + k <= size[fits]) & sought[np.minimum(size[fits], PIECED)])
        found.append((run[at], line[at], np.zeros(len(at), bool), first[at] & OWN[k][np.minimum(size[at], PIECED)]))
    return found


def least_runs(ids: np.ndarray, line: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, line, size) of the up to SAMPLE runs with the least hashes of each line."""
    if not len(ids):
        return ids, line, size
    run = runs_of(ids, RUN)
    line, place, size = line[: len(run)], place[: len(run)], size[: len(run)]
    fits = place + RUN <= size
    # few of a long line's runs are among the least
    low = (run >> np.uint64(44)).astype(np.int64) * size < 3 * SAMPLE << 20
    few = fits & low
    lacking = np.bincount(line[few], minlength=line[-1] + 1) < SAMPLE
    at = np.flatnonzero(few | (fits & lacking[line]))
    at = at[np.argsort(line[at].astype(np.uint64) << np.uint64(40) | run[at] >> np.uint64(24))]
    at = at[np.append(True, (line[at][1:] != line[at][:-1]) | (run[at][1:] != run[at][:-1]))[: len(at)]]
    head = np.append(True, line[at][1:] != line[at][:-1])[: len(at)]
    at = at[np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0)) < SAMPLE]
    return run[at], line[at], size[at]


def word_sets(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that mark each line's words, as two numbers."""
    bit, upper = np.uint64(1) << (ids >> np.uint64(58)), (ids >> np.uint64(57)) & np.uint64(1) == 1
    return tuple(np.bitwise_or.reduceat(np.where(upper == half, bit, np.uint64(0)), starts) for half in (False, True))


def pair_simhashes(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of SimHash of each line's pairs of words, as two numbers; 0 for lines of fewer than those of far runs."""
    n = np.diff(np.append(starts, len(ids)))
    far = n >= reaches(SET_WORDS)
    both = np.zeros((2, len(n)), np.uint64)
    if far.any():
        last = np.zeros(len(ids), bool)
        last[np.append(starts[1:], len(ids)) - 1] = True
        pairs = np.append(runs_of(ids, 2), np.zeros(1, np.uint64))[np.repeat(far, n) & ~last]
        firsts = np.cumsum(n[far] - 1) - (n[far] - 1)
        for k in range(2):
            both[k, far] = simhashes(mixed(pairs + np.uint64(k)), firsts)
    return both[0], both[1]


#: What is known of a line where it meets others by a run of words: the run, the line's key, its set or SimHash, its words, the kind of run, and its form.
ROW = np.dtype([("run", "<u4"), ("id", "<i8"), ("a", "<u8"), ("b", "<u8"), ("n", "<u4"), ("own", "?"), ("far", "?"), ("form", "u1")])
#: Words up to which a line's set is packed in 32, 64 and 128 bits, of which shorter lines need no more; longer lines and far runs have the last form.
FORM_WORDS = (20, 48, SET_WORDS)
#: The forms in which rows are shuffled. ``n`` has the number of words, and in its two lowest bits whether the run is far and the line's own.
FORMS = [np.dtype([("run", "<u4"), ("id", "<i8"), ("n", n), *marks]) for n, marks in (("u1", [("a", "<u4")]), ("u1", [("a", "<u8")]), ("<u2", [("a", "<u8"), ("b", "<u8")]), ("<u4", [("a", "<u8"), ("b", "<u8")]))]
#: A line's document, key, and number in it.
LINE = np.dtype([("did", "<i8"), ("row", "<i8"), ("key", "<i8"), ("line_no", "<i4")])
#: What comes of a shard: a line (key, did, row, line_no), an edge between keys, a key in a group (a run that many unlike lines have), or a key
#: among those that edges of a run connect, in which edges stand for pairs that aren't written.
FOUND = "kind int, a long, b long, c long, line_no int"
IS_LINE, IS_EDGE, IS_GROUP, IS_SHARED = range(4)


def folded(a: np.ndarray, b: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets of words with the bits that those of ``form`` have."""
    a, b = np.where(form < 2, a | b, a), np.where(form < 2, np.uint64(0), b)
    return np.where(form < 1, (a | a >> np.uint64(32)) & np.uint64(0xFFFFFFFF), a), b


def packed_rows(h: np.ndarray, line: np.ndarray, far: np.ndarray, own: np.ndarray, shard: np.ndarray, key: np.ndarray, n: np.ndarray, marks: tuple, sims: tuple, shards: int) -> tuple[np.ndarray, list[bytes]]:
    """The shards that have rows, and for each the number of its rows of each form and these rows."""
    of_line = np.searchsorted(FORM_WORDS, n).astype(np.uint8)
    sets = folded(*marks, of_line)
    form = np.where(far, np.uint8(len(FORMS) - 1), of_line[line])
    group = shard.astype(np.uint32) * np.uint32(len(FORMS)) + form
    counts = np.bincount(group, minlength=shards * len(FORMS)).astype("<u4").reshape(shards, -1)
    parts = []
    for k, kind in enumerate(FORMS):
        at = np.flatnonzero(form == k)
        at = at[np.argsort(shard[at], kind="stable")]
        of, out = line[at], np.empty(len(at), kind)
        out["run"], out["id"] = h[at] & np.uint64(0xFFFFFFFF), key[of]
        out["n"] = n[of] << 2 | far[at].astype(np.int64) << 1 | own[at]
        for i, half in enumerate(kind.names[3:]):
            out[half] = np.where(far[at], sims[i][of], sets[i][of]) if k == len(FORMS) - 1 else sets[i][of]
        parts.append((out.view(np.uint8).data if len(out) else memoryview(b""), np.append(0, np.cumsum(counts[:, k], dtype=np.int64)) * kind.itemsize))
    some = np.flatnonzero(counts.any(1))
    return some, [b"".join([counts[s].tobytes(), *(data[at[s] : at[s + 1]] for data, at in parts)]) for s in some.tolist()]


def unpacked(parts: list[bytes]) -> list[np.ndarray]:
    """The rows of each form in ``parts``."""
    found: list[list] = [[] for _ in FORMS]
    for part in parts:
        at = 4 * len(FORMS)
        for rows, kind, count in zip(found, FORMS, np.frombuffer(part, "<u4", len(FORMS)).tolist(), strict=True):
            if count:
                rows.append(np.frombuffer(part, kind, count, at))
            at += count * kind.itemsize
    return [np.concatenate(rows) if rows else np.empty(0, kind) for rows, kind in zip(found, FORMS, strict=True)]


def piece_table(docs: DataFrame, shards: list[int], exact: bool = False) -> DataFrame:
    """(shard, rows, lines): packed rows of the lines of ``docs(did, row, text)``, dealt to ``shards`` by the runs' hashes, and LINEs, in turn.

    A line that is repeated within a task has mostly one lot of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, labels, turn = set(), np.array(shards), 0
        for rows in flushes(batches, "text"):
            found = Lines([r["text"] for r in rows])
            place = np.empty(len(found.key), LINE)
            place["key"], place["line_no"] = found.key, found.line_no
            for k in ("did", "row"):
                place[k] = np.array([r[k] for r in rows], np.int64)[found.text]
            turn = (turn + 1 + int(place["row"][:1].sum())) % len(labels)
            yield pa.RecordBatch.from_arrays([pa.array(labels[[turn]], pa.int32()), pa.nulls(1, pa.binary()), pa.array([place.tobytes()], pa.binary())], ["shard", "rows", "lines"])
            key, first = np.unique(found.key, return_index=True)
            first = first[found.size[first] >= EDITS]
            first = np.sort(first[[k not in seen for k in found.key[first].tolist()]])
            if len(seen) > 100_000:
                seen.clear()
            seen.update(found.key[first].tolist())
            if not len(first):
                continue
            n = found.size[first]
            starts = np.cumsum(n) - n
            ids = found.ids[np.repeat(found.starts[first] - starts, n) + np.arange(n.sum())]
            marks, sims = word_sets(ids, starts), pair_simhashes(ids, starts)
            h, line, far, own = pieces(ids, starts, exact)
            shard = ((h >> np.uint64(32)) % np.uint64(len(labels))).astype(np.uint16 if len(labels) < 1 << 16 else np.uint32)
            some, packed = packed_rows(h, line, far, own, shard, found.key[first], n, marks, sims, len(labels))
            yield pa.RecordBatch.from_arrays([pa.array(labels[some], pa.int32()), pa.array(packed, pa.binary()), pa.nulls(len(some), pa.binary())], ["shard", "rows", "lines"])

    return docs.select("did", "row", "text").mapInArrow(run, "shard int, rows binary, lines binary")


def excess(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how much rows x and y of the same run differ, as a share of what those of similar lines may; infinite if they can't be."""
    nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
    most = np.maximum(nx, ny) // EDITS
    ok = (np.abs(nx - ny) <= most) & ((x["own"] & (nx >= ny)) | (y["own"] & (ny >= nx)))
    xs, ys = (x["a"], x["b"]), (y["a"], y["b"])
    if (x["form"] != y["form"]).any():
        least = np.minimum(x["form"], y["form"])
        xs, ys = folded(*xs, least), folded(*ys, least)
    only = [np.bitwise_count(p[0] & ~q[0]).astype(np.int64) + np.bitwise_count(p[1] & ~q[1]) for p, q in ((xs, ys), (ys, xs))]
    return np.where(ok, np.where(x["far"], (only[0] + only[1]) / RADIUS, np.maximum(*only) / np.maximum(most, 1)), np.inf)


def shared_runs(parts: list[bytes]) -> np.ndarray:
    """The rows of runs that several lines have, one of them as its own, in order of run and line."""
    forms = unpacked(parts)
    run = np.concatenate([x["run"] for x in forms])
    order = np.sort(run.astype(np.uint64) << np.uint64(32) | np.arange(len(run), dtype=np.uint64))
    run = order >> np.uint64(32)
    new = np.append(True, run[1:] != run[:-1])[: len(run)]
    alone = new & np.append(new[1:], True)[: len(run)]
    at = np.sort(order[~alone] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # only rows of runs that are repeated are widened
    rows, bounds = np.zeros(len(at), ROW), np.cumsum([0, *map(len, forms)])
    for k, (some, lo, hi) in enumerate(zip(forms, *np.searchsorted(at, (bounds[:-1], bounds[1:])), strict=True)):
        out, some = rows[lo:hi], some[at[lo:hi] - bounds[k]]
        for name in ("run", "id", *some.dtype.names[3:]):
            out[name] = some[name]
        out["n"], out["far"], out["own"], out["form"] = some["n"] >> 2, some["n"] >> 1 & 1, some["n"] & 1, k
    if not len(rows):
        return rows
    rows = rows[np.lexsort((~rows["own"], rows["id"], rows["run"]))]
    rows = rows[np.append(True, (rows["run"][1:] != rows["run"][:-1]) | (rows["id"][1:] != rows["id"][:-1]))]
    first, count = run_bounds(rows)
    good = (count > 1) & np.logical_or.reduceat(rows["own"], first)
    return rows[np.repeat(good, count)]


def run_bounds(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run's rows begin, and how many they are, of rows in order."""
    first = np.flatnonzero(np.append(True, rows["run"][1:] != rows["run"][:-1])) if len(rows) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(rows)))


def run_links(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(edges, rest, held, part): pairs of places in ``rows`` that connect the lines of a run that may be similar, and the rows of runs with too many unlike lines.

    In runs of many lines those that are very close are connected first, so that
    they stay connected whatever becomes of the other edges. ``held`` are the
    rows of these runs that edges connect, and ``part`` names what connects
    them: not all of its pairs have edges, so that if some of its edges turn out
    to be none, its lines must be compared again.
    """
    first, count = run_bounds(rows)
    edges, rest, held, part = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in range(2, PAIRS_UP_TO + 1):
        a, b = np.triu_indices(c, 1)
        every = first[count == c]
        for some in np.array_split(every, len(every) * len(a) // 1_000_000 + 1):
            x, y = (some[:, None] + a).ravel(), (some[:, None] + b).ravel()
            ok = excess(rows[x], rows[y]) <= 1
            edges.append(np.stack([x[ok], y[ok]], 1))
    for f, c in zip(first[count > PAIRS_UP_TO].tolist(), count[count > PAIRS_UP_TO].tolist(), strict=True):
        own = rows[f : f + c]
        forests = [spread_wide(c, lambda some, todo, own=own, share=share: excess(own[some][:, None], own[todo]) <= share, TESTS * c) for share in CLOSE]
        if None in forests:
            rest.append(np.arange(f, f + c))
        else:
            edges += [links + f for forest in forests for links in forest]
            label = np.arange(c)
            for links in forests[-1]:  # lines come from those that were reached before
                label[links[:, 1]] = label[links[:, 0]]
            several = np.flatnonzero(np.bincount(label, minlength=c)[label] > 2)
            held.append(several + f)
            part.append(label[several] + f)
    return np.concatenate(edges), np.concatenate(rest), np.concatenate(held), np.concatenate(part)


def found_rows(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of FOUND; columns that aren't given are 0."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    whole = [np.full(len(columns[0]), kind, np.int32), *columns, *[np.zeros(len(columns[0]), np.int64)] * (4 - len(columns))]
    for k in range(0, len(columns[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[k : k + 50_000], np.int32 if n in ("kind", "line_no") else np.int64)) for n, x in zip(names, whole, strict=True)], names)


def lines_and_candidates(docs: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines(did, row, line_no, key), edges(a, b), groups(gid, id), shared(gid, id)) of ``docs(did, row, text)``.

    ``lines`` has every line with a word; keys of lines that may be similar are
    connected by edges or in a group. ``shared`` are the lines of a run of many
    that its edges connect.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a value for each partition, so that each gets one shard
    dealt = spark.range(40 * n).select(F.col("id").cast("int").alias("v")).groupBy(F.pmod(F.hash("v"), F.lit(n)).alias("p")).agg(F.min("v").alias("v"))
    shards = sorted(r["v"] for r in dealt.collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for shard, part, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lines is not None:
                    place = np.frombuffer(lines, LINE)
                    yield from found_rows(IS_LINE, place["key"], place["did"], place["row"], place["line_no"])
                else:
                    held.setdefault(shard, []).append(part)
        for shard in list(held):
            rows = shared_runs(held.pop(shard))
            if not len(rows):
                continue
            at, rest, held_rows, part = run_links(rows)
            ends = np.unique(np.sort(rows["id"][at], axis=1), axis=0)
            yield from found_rows(IS_EDGE, ends[:, 0], ends[:, 1])
            yield from found_rows(IS_GROUP, rows["id"][rest], rows["run"][rest].astype(np.int64) | np.int64(shard) << np.int64(32))
            name = mixed(rows["id"][part].view(np.uint64) ^ mixed(rows["run"][part].astype(np.uint64)))
            yield from found_rows(IS_SHARED, rows["id"][held_rows], name.view(np.int64))

    found = durable(piece_table(docs, shards, exact).repartition(n, "shard").mapInArrow(run, FOUND))
    lines = found.where(F.col("kind") == IS_LINE).select(F.col("b").alias("did"), F.col("c").alias("row"), "line_no", F.col("a").alias("key"))
    named = lambda kind: found.where(F.col("kind") == kind).select(F.col("b").alias("gid"), F.col("a").alias("id"))
    return lines, found.where(F.col("kind") == IS_EDGE).select("a", "b"), named(IS_GROUP), named(IS_SHARED)


def places(a: list) -> dict:
    """For each word of a line, the bits of its places."""
    bits: dict = {}
    for i, w in enumerate(a):
        bits[w] = bits.get(w, 0) | 1 << i
    return bits


def edit_distance(a: list, b: list, most: int, spots: dict | None = None) -> int:
    """Edits (insert, delete, replace) from a to b, or most + 1 if there are more.

    A column of the table of distances is held as two bit sets of its steps up
    and down, so a word of b takes a few operations on numbers of len(a) bits.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if not n:
        return m
    spots = places(a) if spots is None else spots
    whole, last = (1 << n) - 1, 1 << (n - 1)
    up, down, score = whole, 0, n
    for j, w in enumerate(b):
        same = spots.get(w, 0)
        diagonal = (((same & up) + up) ^ up) | same
        rise, fall = down | (whole & ~(diagonal | up)), up & diagonal
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        if score - (m - j - 1) > most:
            return most + 1
        rise, vertical = rise << 1 | 1, same | down
        up, down = (fall << 1 | ~(vertical | rise)) & whole, rise & vertical & whole
    return min(score, most + 1)


def numbered(words: list[bytes]) -> list[tuple[bytes, int]]:
    """Each word with the number of its occurrence."""
    times: dict[bytes, int] = {}
    out = []
    for w in words:
        times[w] = times.get(w, 0) + 1
        out.append((w, times[w]))
    return out


def link(payloads: list[bytes]) -> list[tuple[int, int]]:
    """A spanning forest of the similar lines.

    Lines that share so few words, counted with their repetitions, that no
    order of them could be similar are told apart without an alignment.
    """
    words = [p.split() for p in payloads]
    seen: dict[tuple[bytes, int], int] = {}
    ids = [seen.setdefault(x, len(seen)) for line in words for x in numbered(line)]
    at, size = np.array(ids), np.array([len(w) for w in words])
    starts, mark = np.cumsum(size) - size, np.zeros(len(seen), np.int64)

    def near(i: int, todo: np.ndarray) -> np.ndarray:
        longest = np.maximum(size[todo], size[i])
        most = longest // EDITS
        own = at[starts[i] : starts[i] + size[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[at], starts)[todo]
        mark[own] = 0
        ok = longest - both <= most
        spots = places(words[i]) if ok.any() else {}
        return np.array([j for j, k in zip(todo[ok].tolist(), most[ok].tolist(), strict=True) if edit_distance(words[i], words[j], k, spots) <= k], int)

    return spread(len(words), near)


def elements(payload: bytes) -> tuple[np.ndarray, int]:
    """Hashes of a line's numbered words, and how many of them, the rarest, two similar lines share one of."""
    words = payload.split()
    return np.array([hash_of(w, k) for w, k in numbered(words)], np.int64), len(words) // EDITS + 1


def needed(n: Column, m: Column) -> Column:
    """Numbered words that similar lines of n and m words have in common."""
    return F.greatest(n, m) - F.floor(F.greatest(n, m) / EDITS)


def hash_of(word: bytes, no: int) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(word, no)
    return h - (1 << 64) if h >> 63 else h


def with_row(docs: DataFrame) -> DataFrame:
    """``docs`` and a key of each row: the doc_id (null: -1) and a hash of it and the text."""
    return docs.withColumns({"did": F.coalesce("doc_id", F.lit(-1)).cast("long"), "row": F.xxhash64("doc_id", "text")})


def repetitions(hashes: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Hashes of the words with the numbers of their occurrences in their lines."""
    order = np.lexsort((hashes, line))
    new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1]))[: len(order)]
    no = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.empty_like(hashes)
    out[order] = mixed(hashes[order] + no.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def candidate_words(docs: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, n, payload, marks) of the lines whose keys are ``wanted(key)``: their words, and SET_BITS bits that mark these, each repetition apart."""
    place = F.struct("did", "row", "line_no")
    first = lines.join(sized(wanted), "key").groupBy("key").agg(F.min(place).alias("first"))
    of_doc = durable(first.groupBy("first.did", "first.row").agg(F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), F.col("key").alias("id"))).alias("asked")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in flushes(batches, "text"):
            ids, payloads = [], []
            for r in rows:
                split = r["text"].split("\n")
                for w in r["asked"]:
                    ids.append(w["id"])
                    payloads.append(b" ".join(line_words(split[w["line_no"]])))
            hashes, line, _ = words_of(payloads)
            bits = np.zeros((len(ids), SET_BITS), bool)
            bits[line, (repetitions(hashes, line) >> np.uint64(32)).astype(np.int64) % SET_BITS] = True
            n = np.bincount(line, minlength=len(ids)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(payloads, pa.binary()), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], ["id", "n", "payload", "marks"])

    texts = docs.select("did", "row", "text").join(sized(of_doc), ["did", "row"])
    known = compact(texts.select("text", "asked").mapInArrow(run, "id long, n int, payload binary, marks binary"))
    # rows of documents that are repeated whole give their lines repeatedly
    return known if known.count() == wanted.count() else compact(known.dropDuplicates(["id"]))


def marked_alike(edges: DataFrame, known: DataFrame) -> DataFrame:
    """The ``edges(a, b)`` between lines of ``known(id, n, marks)`` whose sets of words differ in no more than similar ones can."""
    for k in "ab":
        edges = edges.join(known.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("marks").alias(f"marks_{k}")), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(f"marks_{k}").to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in "ab")
                most = np.maximum(*(batch.column(f"n_{k}").to_numpy() for k in "ab")) // EDITS
                ok = (np.bitwise_count(x & ~y).sum(1, dtype=np.int64) <= most) & (np.bitwise_count(y & ~x).sum(1, dtype=np.int64) <= most)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return edges.mapInArrow(run, "a long, b long")


def parted(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``shared(gid, id)`` whose lines are in several of ``groups(gid, id)``, or in none; groups of the same lines count once."""
    own = groups.select("id", F.col("gid").alias("own"))
    named = shared.join(sized(own), "id", "left").select("gid", "id", F.coalesce("own", "id").alias("own"))
    apart = named.groupBy("gid").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("ids")).where("lo < hi")
    once = compact(apart.groupBy("n", "ids").agg(F.min("gid").alias("gid")).select("gid"))
    return shared.join(sized(once), "gid")


def repeated_lines(docs: DataFrame, exact: bool = False) -> DataFrame:
    """(did, row, lines): the numbers of the lines that go, of each row of :func:`with_row` that has such."""
    lines, edges, large, shared = lines_and_candidates(docs, exact)
    edges = compact(edges.distinct())
    ends = edges.select(F.explode(F.array("a", "b")).alias("key")).unionByName(large.select(F.col("id").alias("key")))
    known = candidate_words(docs, lines, compact(ends.distinct()))
    alike = compact(connected_components(marked_alike(edges, known)).select(F.col("component").alias("gid"), F.col("node").alias("id")))
    groups = alike.unionByName(large).unionByName(parted(shared, alike))
    items = groups.join(known.select("id", F.col("n").alias("weight")), "id").select("id", "gid", "weight")
    linked = compact(linked_components(items, lambda asked: known.select("id", "payload").join(sized(asked), "id"), link, BLOCK_WEIGHT, elements, needed))
    named = lines.join(sized(linked), F.col("key") == F.col("node"), "left").select("did", "row", "line_no", F.coalesce("component", "key").alias("group"))
    several = compact(named.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group"))
    again = durable(named.join(sized(several), "group"))
    kept = compact(again.groupBy("group").agg(F.min(F.struct("did", "row", "line_no")).alias("kept")))
    gone = again.join(sized(kept), "group").where((F.col("did") != F.col("kept.did")) | (F.col("row") != F.col("kept.row")) | (F.col("line_no") != F.col("kept.line_no")))
    return gone.groupBy("did", "row").agg(F.collect_set("line_no").alias("lines"))


def dedup_lines(docs: DataFrame, exact: bool = False) -> DataFrame:
    """``docs`` with its repeated and nearly repeated lines cut from ``text``.

    Adds n_lines (before) and n_removed to all columns. Of each group the
    occurrence with the least doc_id, then the first in the text, stays. Lines
    are what newlines part; lines without a word stay, and lines of fewer than
    EDITS words are similar only if equal. Letters of scripts that put no spaces
    between words count as words. Null and empty texts are returned as they
    are, with 0 lines if null. Lines of over PIECED words are compared if they
    share one of SAMPLE runs of words; ``exact`` looks for the pieces of all
    lines instead, with about a row for each word. Rows that repeat a doc_id and a text are one
    document; a null doc_id comes before all others. An empty table gives an
    empty result.
    """
    keyed = with_row(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns if c in ("did", "row", "lines", "n_lines", "n_removed")}))
    gone = durable(repeated_lines(keyed, exact))

    joined = keyed.join(sized(gone), ["did", "row"], "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    counted = joined.withColumns({"n_lines": n_lines.cast("long"), "n_removed": F.coalesce(F.size("lines"), F.lit(0)).cast("long")})
    stay = F.array_except(F.sequence(F.lit(0), (F.col("n_lines") - 1).cast("int")), "lines")
    # the parts are bound to a lambda's variable, so that a text is split once
    parts = F.array(F.struct(F.split("text", "\n", -1).alias("lines"), stay.alias("stay")))
    cut = F.transform(parts, lambda x: F.array_join(F.transform(x["stay"], lambda i: x["lines"][i]), "\n"))[0]
    changed = counted.withColumn("text", F.when(F.col("n_removed") > 0, cut).otherwise(F.col("text")))
    kept = changed.select(*[c for c in keyed.columns if c not in ("did", "row")], "n_lines", "n_removed")
    return kept.withColumnsRenamed({f"in_{c}": c for c in ("did", "row", "lines") if f"in_{c}" in kept.columns})


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
