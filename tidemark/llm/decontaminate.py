"""Benchmark decontamination: pieces of items counted by diagonal, exact edit verification.

Of an item, p pieces of q characters are taken that do not overlap. Where it lies in a text with k edits, each edit
spoils one piece at most, so the text has at least p - k of them, and their diagonals (place in the text less place in
the item) are at most k apart. Pieces are counted by item and band of diagonals. Wherever neighbouring bands hold that
many, the item is cut into parts of about PART characters, of which one of n has at most k / n edits: these are looked
for at many places at once, and where one is near enough the item's edit distance is computed. So no leak within the
declared edits is lost, wherever its edits are, and whichever pieces are taken: they are those that are rare in texts.
q is GRAM, or less in short items.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import few, pieces

#: Characters of a piece at most, bits of its hash, neighbouring bands that are counted together, and bits of a band's width at least.
GRAM, BITS, BANDS, SHIFT = 4, 18, 6, 4
#: Diagonals that are looked at together.
SPREAD = 64
#: Characters of a part at most: bits of a machine word.
PART = 64
#: Characters of text whose grams are counted at a time, and bands of all parts of a group at most.
CHUNK, MOST_BINS = 1 << 14, 4_000_000
#: Places that are compared with their parts at a time.
LANES = 1 << 13
#: Items of more characters take every q-th place; in others the pieces are chosen one by one.
CHOSEN = 1000
#: Edits that a leak has at most, as a share of the item's characters.
EDITS = 0.2
#: Of the benchmark, so many bytes (in expectation) are sent to every task at a time; a larger one is judged shard by shard.
SHARD_BYTES = 2_000_000
#: Between texts; no normal text or item has it.
GAP = "\n"
#: What normal() takes for white space: the same as bytes.split().
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def normal(text: str) -> str:
    """A-Z lower-cased, runs of white space as one space."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_LOWER).split()).decode("utf-8", "surrogatepass")


_LOWER = bytes(c + 32 * (65 <= c < 91) for c in range(256))


def normal_bytes(text: bytes) -> str:
    """normal() of UTF-8, without what is none."""
    try:
        return b" ".join(text.translate(_LOWER).split()).decode()
    except UnicodeDecodeError:
        return normal(text.decode("utf-8", "ignore"))


def distance(item: str, text: str) -> tuple[int, int]:
    """Least edit distance between item and any substring of text, and where the first best one ends (bit-parallel, one word of len(item) bits)."""
    m = len(item)
    if not m:
        return 0, 0
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        x = masks.get(c, 0)
        d = ((((x & plus) + plus) ^ plus) | x | minus) & full
        hp, hm = minus | (full & ~(d | plus)), plus & d
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp, hm = (hp << 1) & full, (hm << 1) & full  # a match may start anywhere in text
        plus, minus = hm | (full & ~(d | hp)), hp & d
        if score < best:
            best, end = score, j + 1
    return best, end


def chosen(often: np.ndarray, q: int, edits: int) -> np.ndarray:
    """Places of an item's pieces, which do not overlap: those that a text without the item is least likely to have enough of by chance.

    often: the share of a text's places that have the gram of each place of the item.
    """
    n = len(often)
    if n > CHOSEN:
        first = min((a for a in range(q) if len(often[a::q]) > edits), key=lambda a: (often[a::q].mean(), a))
        return np.arange(first, n, q)
    most = (n + q - 1) // q
    sums = np.full((most + 1, n + q), np.inf)  # the least sum of j pieces that end at a place or before
    sums[0] = 0
    for j in range(1, most + 1):
        sums[j, q:] = np.minimum.accumulate(sums[j - 1, :-q] + often)
    # the exponent of Chernoff's bound for as many hits as an item with that many pieces needs
    pieces_ = np.arange(edits + 1, most + 1)
    least, mean = pieces_ - edits, np.maximum(sums[edits + 1 :, -1] * (edits + 1), 1e-12)
    j = int(pieces_[np.argmax(np.where(least > mean, least * np.log(least / mean) - least + mean, least - mean))])
    end, out = n + q - 1, []
    while j:
        end = int(np.searchsorted(-sums[j], -sums[j, end]))
        end, j = end - q, j - 1
        out.append(end)
    return np.array(out[::-1])


class Group:
    """Items of one gram length and band width, as a direct-address table from a gram's hash to the pieces that have it."""

    def __init__(self, q: int, shift: int, members: list[tuple[int, np.ndarray, int]], often: np.ndarray):
        self.q, self.shift = q, shift
        self.owners = np.array([n for n, _, _ in members])
        self.most = np.array([k for _, _, k in members])
        self.longest = max(len(x) for _, x, _ in members)
        self.chunk = max(CHUNK, 4 * (self.longest + int(self.most.max())))
        self.lead = self.longest + (1 << shift)  # no diagonal lies in the first band, which no window has
        self.bands = ((self.chunk + self.lead) >> shift) + 1 + BANDS
        codes = [grams(x, q) for _, x, _ in members]
        places = [chosen(often[c], q, k) for c, (_, _, k) in zip(codes, members, strict=True)]
        taken = np.array([len(x) for x in places])
        self.least = taken - self.most
        base = np.repeat(np.arange(len(members)) * self.bands, taken)
        every = np.concatenate([c[x] for c, x in zip(codes, places, strict=True)])
        order = np.argsort(every, kind="stable")
        # (place in the chunk + this) >> shift is the band of the item's first character
        self.entries = ((base << shift) + self.lead - np.concatenate(places))[order].astype(np.int32)
        self.counts = np.bincount(every, minlength=1 << BITS).astype(np.int32)
        self.firsts = (np.cumsum(self.counts) - self.counts).astype(np.int32)
        self.kind = np.int16 if (int(taken.max()) * BANDS) << shift < 1 << 15 else np.int64
        self.enough = np.repeat(self.least.astype(self.kind), self.bands)
        self.run = np.arange(1 << 20, dtype=np.int32)
        # An item's parts, and for each part and character the places of the part that have it, as bits; column 0 is of characters of no part.
        cuts = [np.linspace(0, len(x), max(1, -(-len(x) // PART)) + 1).astype(int) for _, x, _ in members]
        self.parts = np.array([len(c) - 1 for c in cuts])
        self.first_part = np.cumsum(self.parts) - self.parts
        self.places, self.sizes = np.concatenate([c[:-1] for c in cuts]), np.concatenate([np.diff(c) for c in cuts])
        self.edits = np.repeat(self.most // self.parts, self.parts)
        some = np.unique(np.concatenate([x for _, x, _ in members]))
        self.columns = np.zeros(0x110000, np.int32)
        self.columns[some] = np.arange(1, len(some) + 1)
        self.masks = np.zeros((len(self.sizes), len(some) + 1), np.uint64)
        for m, (at, size, of) in enumerate(zip(self.places, self.sizes, np.repeat(np.arange(len(members)), self.parts), strict=True)):
            np.bitwise_or.at(self.masks[m], self.columns[members[of][1][at : at + size]], np.uint64(1) << np.arange(size, dtype=np.uint64))

    def counted(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(member, diagonal) wherever, from that diagonal on, enough pieces lie at most the member's edits apart."""
        step = self.chunk - self.longest - int(self.most.max())
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for a in range(0, len(codes), step):
            part = codes[a : a + self.chunk]
            n = self.counts[part]
            at = np.flatnonzero(n)
            n = n[at]
            # the entries of each place's gram, and the bands in which they are
            entry = np.repeat(self.firsts[part[at]] - (np.cumsum(n, dtype=np.int32) - n), n)
            entry += self.run[: len(entry)] if len(entry) <= len(self.run) else np.arange(len(entry), dtype=np.int32)
            line = self.entries[entry]
            line += np.repeat(at.astype(np.int32), n)
            band = line >> self.shift
            held = np.bincount(band, minlength=len(self.enough) + BANDS).astype(self.kind)
            some = held[:-BANDS].copy()
            for i in range(1, BANDS):
                some += held[i : i - BANDS]
            full = np.flatnonzero(some >= self.enough)
            if not len(full):
                continue
            # of these bands, the pieces' very diagonals
            inside = np.zeros(len(held), bool)
            for i in range(BANDS):
                inside[full + i] = True
            line = np.sort(line[inside[band]])
            m = line // (self.bands << self.shift)
            last = np.arange(len(line)) + self.least[m] - 1
            far = line[np.minimum(last, len(line) - 1)] - line
            kept = np.flatnonzero((last < len(line)) & (far <= self.most[m]))
            found.append((m[kept], line[kept].astype(np.int64) - m[kept] * (self.bands << self.shift) - self.lead + a))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def near(self, codes: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, begin, end): between which diagonals of a text, given by its grams and characters, the first of an item's pieces may lie; others of its characters are its edits away at most."""
        m, begin = self.counted(codes)
        if not len(m):
            return
        edits, width = int(self.most.max()), int(self.sizes.max()) + SPREAD + 2 * int(self.most.max())
        pad = np.zeros(self.lead + width + edits, np.int32)  # around the text stands the character of no part
        columns = np.concatenate([pad, self.columns[data], pad])
        # diagonals that lie in a spread are looked at together
        m, begin = np.unique(np.stack([m, begin // SPREAD]), axis=1)
        begin = begin * SPREAD
        for i in range(0, len(m), LANES):
            n = self.parts[m[i : i + LANES]]
            of = np.repeat(np.arange(i, i + len(n)), n)
            p = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.first_part[m[of]]
            kept = self.close(columns, len(pad), p, begin[of] + self.places[p] - self.most[m[of]], width)
            for k in np.unique(of[kept]).tolist():
                yield int(self.owners[m[k]]), int(begin[k]), int(begin[k]) + SPREAD

    def close(self, columns: np.ndarray, pad: int, m: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
        """Whether each part m is within its edits somewhere in the width characters from begin (bit-parallel, as in distance)."""
        one, top, edits = np.uint64(1), (self.sizes[m] - 1).astype(np.uint64), self.edits[m]
        plus, minus = np.full(len(m), 2**64 - 1, np.uint64), np.zeros(len(m), np.uint64)
        score, found, lanes = self.sizes[m].astype(np.int64), np.zeros(len(m), bool), np.arange(len(m))
        best, row, masks, at = score.copy(), m * self.masks.shape[1], self.masks.ravel(), np.clip(begin + pad, 0, len(columns) - width)
        for j in range(width):
            x = masks[row + columns[at + j]]
            d = (((x & plus) + plus) ^ plus) | x | minus
            hp, hm = minus | ~(d | plus), plus & d
            score += (((hp >> top) & one) - ((hm >> top) & one)).view(np.int64)
            hp <<= one
            hm <<= one
            plus, minus = hm | ~(d | hp), hp & d
            np.minimum(best, score, out=best)
            if j % 8 == 7 or j == width - 1:
                found[lanes[best <= edits]] = True
                left = (best > edits) & (score - edits <= width - 1 - j)  # a step changes the score by one at most
                if not left.all():
                    lanes, row, at, plus, minus, score, best, top, edits = (v[left] for v in (lanes, row, at, plus, minus, score, best, top, edits))
                    if not len(lanes):
                        break
        return found


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of BITS bits of the q characters from each place."""
    out = np.zeros(max(0, len(codes) - q + 1), np.uint32)
    for i in range(q):
        out = (out ^ codes[i : i + len(out)]) * np.uint32(0x9E3779B1)
        out ^= out >> np.uint32(15)
    return out >> np.uint32(32 - BITS)


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Items:
    """The benchmark in groups, none of which has more than MOST_BINS bands to count in. Pieces are chosen by how often some texts, if given, and the items have them."""

    def __init__(self, rows: list[tuple[int, str]], edits: float, texts: Sequence[str] = ()):
        self.ids, self.texts = [r[0] for r in rows], [normal(r[1]) for r in rows]
        self.most = [int(edits * len(t)) for t in self.texts]
        kinds: dict[tuple[int, int], list[tuple[int, np.ndarray, int]]] = {}
        always: list[int] = []
        for n, (text, k) in enumerate(zip(self.texts, self.most, strict=True)):
            q = min(GRAM, len(text) // (k + 1))
            if q:
                shift = max(SHIFT, math.ceil(math.log2(max(1, k / (BANDS - 1)))))
                kinds.setdefault((q, shift), []).append((n, characters(text), k))
            else:
                always.append(n)
        self.always = always  # so many edits that no piece need stay whole
        self.groups = []
        seen = characters(GAP.join([*texts, *self.texts]))
        often = {}
        for q in {q for q, _ in kinds}:
            n = np.bincount(grams(seen, q), minlength=1 << BITS)
            often[q] = n / n.sum()
        for (q, shift), members in sorted(kinds.items()):
            members.sort(key=lambda x: len(x[1]))
            begin = 0
            while begin < len(members):
                # The longest item so far sets every item's diagonals; groups are cut where they become too many.
                end = begin + 1
                while end < len(members) and (end + 1 - begin) * (CHUNK + 9 * len(members[end][1]) + ((BANDS + 3) << shift)) < min(MOST_BINS << shift, 1 << 30):
                    end += 1
                self.groups.append(Group(q, shift, members[begin:end], often[q]))
                begin = end


def leaks_in(texts: list[str], items: Items) -> list[tuple[int, int, int]]:
    """(row, item, edits) of each item found in each of some normal texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    data = characters(GAP.join(texts))
    found: dict[tuple[int, int], int] = {}

    def look(row: int, item: int, a: int, b: int) -> None:
        d, _ = distance(items.texts[item], texts[row][a:b])
        if d <= items.most[item]:
            found[row, item] = d

    for q in sorted({g.q for g in items.groups}):
        codes = grams(data, q)
        for group in (g for g in items.groups if g.q == q):
            open_: dict[int, tuple[int, int]] = {}
            for item, a, b in group.near(codes, data):
                a, b = a - items.most[item], b + len(items.texts[item]) + 2 * items.most[item]
                # bands that follow on each other are one stretch
                if item in open_ and open_[item][0] <= a <= open_[item][1]:
                    open_[item] = (open_[item][0], max(b, open_[item][1]))
                    continue
                if item in open_:
                    judge(item, *open_[item], starts, sizes, found, look)
                open_[item] = (a, b)
            for item, (a, b) in open_.items():
                judge(item, a, b, starts, sizes, found, look)
    for item in items.always:
        for row in np.flatnonzero(sizes).tolist():
            look(row, item, 0, int(sizes[row]))
    return [(*k, d) for k, d in sorted(found.items())]


def judge(item: int, a: int, b: int, starts: np.ndarray, sizes: np.ndarray, found: dict, look: Callable[[int, int, int, int], None]) -> None:
    """Looks for item in the rows that the stretch from a to b touches."""
    for row in range(max(0, int(np.searchsorted(starts, a, "right")) - 1), int(np.searchsorted(starts, b, "left"))):
        begin, end = max(0, a - int(starts[row])), min(int(sizes[row]), b - int(starts[row]))
        if begin < end and (row, item) not in found:
            look(row, item, begin, end)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS) -> DataFrame:
    """(id, item_id, edits, similarity): one row for each row of docs and each item that it holds with at most ``edits`` x length edits.

    Compared are texts in lower case (A-Z) with white space as single spaces. Null and empty texts and items match
    nothing; repeated rows are judged each; an item_id that is repeated with another text is an item of its own. edits
    is the distance found at the first place that is near enough.
    """
    rows = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).distinct()
    held = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-held // SHARD_BYTES))
    of = F.pmod(F.xxhash64("id", "text"), F.lit(shards))
    return reduce(DataFrame.unionByName, (_leaks_of(docs, rows.where(of == s), id_col, text_col, edits) for s in range(shards)))


def _leaks_of(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, edits: float) -> DataFrame:
    """leaks() of items (id, text) that every task can hold."""
    sent = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in items.collect() if normal(r[1])])
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = None
        for batch in batches:
            for a, _, data, offsets in pieces(batch):
                texts = [normal_bytes(data[x:y].tobytes()) for x, y in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
                items = items or Items(sent.value, edits, texts)
                found = leaks_in(texts, items)
                if found:
                    ids = batch.column(0).take(pa.array([a + f[0] for f in found]))
                    like = [1 - f[2] / max(1, len(items.texts[f[1]])) for f in found]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([items.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32()), pa.array(like)], ["id", "item_id", "edits", "similarity"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, item_id long, edits int, similarity double")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, similarity: every leak of benchmark in documents."""
    return leaks(docs, benchmark).withColumnRenamed("id", "doc_id")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", edits: float = EDITS) -> DataFrame:
    """docs without the rows that hold an item (where an id is repeated, all its rows go together)."""
    held = few(leaks(docs, benchmark, id_col, edits=edits).select(F.col("id").alias("leak_id")).distinct(), "leak-ids")
    return docs.join(held, docs[id_col].eqNullSafe(held["leak_id"]), "left_anti")
