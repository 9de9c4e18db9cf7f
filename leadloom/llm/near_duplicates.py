"""Exact Jaccard self-join on word shingles, and the groups that its links make."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import Rolling, bitmap, chunks, discard, fresh, map_bits, mix, partitions, stage

#: Words of a shingle; two sets link when 100 * intersection >= PERCENT * union.
WORDS = 5
PERCENT = 80
#: Bytes of text that a task works on at once.
SLICE = 1 << 19
#: Bytes of text whose words are hashed at once: some twenty times as much memory.
PIECE = 1 << 18
#: Sizes beyond which the subsets of one set are more than 10^8: never the cheaper way.
ENUMERABLE = 64
#: Frequent shingles that are moved to the end of the order of all shingles (8 bytes each are broadcast);
#: the order decides how long lists get, never which links are found.
FREQUENT = 1 << 18
#: Documents of one slice from which a shingle is reported as frequent, and of all.
SLICE_OFTEN, OFTEN = 2, 8
#: Members of one block of the list of a frequent shingle, about.
BLOCK = 4096
#: Members of a star that one cell compares with each other, about.
TILE = 4096
#: Shingles of these members, about, where a cell counts links on whole texts (8 bytes each, and the texts).
SHINGLES = 1 << 20
#: Sets that are counted against one at a time.
COUNTED = 64

_MULTIPLIERS = mix(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, one text after another, and each text's offsets there.

    A-Z are lower-cased, words end at [space, \\t to \\r]; a text of fewer words is one shingle.
    """
    n = len(offsets) - 1
    if len(data) > PIECE and n > 1:
        at, parts = 0, []
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
            parts.append(shingle_sets(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
            at = to
        return np.concatenate([s for s, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, a in parts]))])
    low = np.frombuffer(data.tobytes().lower(), np.uint8)
    word = ~((low == 32) | ((low >= 9) & (low <= 13)))
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts] = word[starts]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = word[ends]
    begin = np.flatnonzero(first)
    hashes = Rolling(low).hashes(begin, np.flatnonzero(last) + 1)
    doc = np.searchsorted(offsets, begin, "right") - 1
    words = np.bincount(doc, minlength=n)
    if len(hashes) >= WORDS:
        many = len(hashes) - WORDS + 1
        whole = doc[:many] == doc[WORDS - 1 :]
        shingles = np.zeros(many, np.uint64)
        for k in range(WORDS):
            shingles += hashes[k : k + many] * _MULTIPLIERS[k]
        shingles, owner = mix(shingles[whole]), doc[:many][whole]
    else:
        shingles, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(words)])
    short = np.flatnonzero((words > 0) & (words < WORDS))
    if len(short):
        sequence = np.zeros(len(short), np.uint64)
        for k in range(WORDS - 1):
            there = words[short] > k
            sequence[there] += hashes[at[short[there]] + k] * _MULTIPLIERS[k]
        shingles = np.concatenate([shingles, mix(sequence + words[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    keep = np.ones(len(shingles), bool)
    keep[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    shingles, owner = shingles[keep], owner[keep]
    return shingles, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def least_overlap(a: int, b: int) -> int:
    """The smallest intersection that links sets of a and b members."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def partner_sizes(size: int) -> range:
    """Sizes of the sets that can link with one of `size` members."""
    return range(-(-PERCENT * size // 100), 100 * size // PERCENT + 1)


def subset_sizes(size: int) -> list[int]:
    """The fixed sizes of subsets that a small set enumerates: each least overlap with a partner size."""
    return sorted({c for t in partner_sizes(size) if (c := least_overlap(size, t)) <= size})


def subset_keys(size: int) -> int:
    return sum(math.comb(size, c) for c in subset_sizes(size))


def prefix_length(size: int) -> int:
    """Members to look up so that no partner is missed: any partner holds one of so many first members."""
    return size - -(-PERCENT * size // 100) + 1


def boundary(histogram: dict[int, int], list_rows: float) -> int:
    """The size up to which sets enumerate subsets, at the least cost over the documents' sizes.

    A subset costs one key; a member to look up costs one key and the `list_rows` other rows of its list.
    """
    sizes = range(0, ENUMERABLE + 1)

    def scanned(x: int) -> float:
        return sum(n * prefix_length(s) * (1 + list_rows) for s, n in histogram.items() if max(partner_sizes(s)) > x)

    best, least, enumerated = 0, scanned(0), 0.0
    for x in sizes[1:]:
        enumerated += histogram.get(x, 0) * subset_keys(x)
        if enumerated >= least:
            break
        if enumerated + scanned(x) < least:
            best, least = x, enumerated + scanned(x)
    return best


#: log2 of the bits of the smallest parity map: at least eight for each member of a set of up to 64.
LEAST_BITS = 9


def parities(sets: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A map for each set: bit h mod B tells whether an odd number of members h fall there; B is a power of two, at least twice the set's size.

    The bits in which two maps differ are at most as many as the members that only one of the sets has. Maps
    travel with every member of every star, so they are short: in a large set two bits a member tell
    similarities of 0.75 from 0.8, a small set has more.
    """
    sizes = np.diff(at)
    bits = 1 << np.maximum(LEAST_BITS, 1 + np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = base[owner] + (sets & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist())]


def near_sides(doc: np.ndarray, label: np.ndarray, size: np.ndarray, maps: list[bytes], left: np.ndarray, right: np.ndarray, once: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each `left` member i the `right` ones with another label whose parity maps leave a link possible, and the bits in which the maps differ.

    Members come by ascending size. `label` is looked at anew for each i. With `once`, a pair comes from one of its sides only.
    """
    places = np.arange(len(doc))
    width = np.array([len(m) for m in maps])
    rows, words, folded = {}, {}, {}
    for w in np.unique(width).tolist():
        rows[w] = np.flatnonzero(width == w)
        words[w] = np.frombuffer(b"".join(maps[i] for i in rows[w].tolist()), np.uint64).reshape(len(rows[w]), w // 8)
        if w > 8:
            folded[w] = words[w][:, : w // 16] ^ words[w][:, w // 16 :]
    within = np.zeros(len(doc), np.int64)
    for w in rows:
        within[rows[w]] = np.arange(len(rows[w]))
    low, high = np.searchsorted(size, -(-PERCENT * size // 100)), np.searchsorted(size, 100 * size // PERCENT, "right")
    for i in places[left].tolist():
        reach = slice(low[i], high[i])
        open_ = right[reach] & (label[reach] != label[i]) & (doc[reach] != doc[i])
        if once and right[i]:
            open_ &= ~left[reach] | (places[reach] > i)
        if not open_.any():
            continue
        others = places[reach][open_]
        own, w = words[width[i]][within[i]], int(width[i])
        near = []
        for v, mine in ((w, own), (2 * w, own), (w // 2, folded[w][within[i]] if w > 8 else None)):
            if v not in rows or mine is None:
                continue
            some = others[width[others] == v]
            if len(some):
                theirs = (folded if v > w else words)[v][within[some]]
                apart = np.bitwise_count(theirs ^ mine).sum(axis=1, dtype=np.int64)
                # 100 * common >= PERCENT * (m + n - common) bounds m + n - 2 * common.
                may = (100 + PERCENT) * apart <= (100 - PERCENT) * (size[i] + size[some])
                near.append((some[may], apart[may]))
        if near:
            yield i, np.concatenate([x for x, _ in near]), np.concatenate([x for _, x in near])


def proposed_sides(doc: np.ndarray, label: np.ndarray, size: np.ndarray, maps: list[bytes], left: np.ndarray, right: np.ndarray, every: bool) -> np.ndarray:
    """Pairs (i, j), a row each, of a `left` and a `right` member with different labels that near_sides() leaves open.

    Unless `every` pair is asked for, a pair makes one label of the two, so that the pairs are a forest:
    one less than the labels at most.
    """
    # Arrays, not tuples: all pairs of a cell may be some millions.
    out = [np.zeros((0, 2), np.int32)]
    label = label.copy()
    for i, found, apart in near_sides(doc, label, size, maps, left, right):
        if not every and len(found):
            # Of each label the closest member.
            order = np.lexsort((apart, label[found]))
            found = found[order]
            found = found[np.append(True, label[found][1:] != label[found][:-1])]
            label[np.isin(label, label[found])] = label[i]
        if len(found):
            out.append(np.stack([np.full(len(found), i, np.int32), found.astype(np.int32)], axis=1))
    return np.concatenate(out)


def linked_sides(doc: np.ndarray, label: np.ndarray, size: np.ndarray, maps: list[bytes], left: np.ndarray, right: np.ndarray, members: Callable[[list[int]], list[np.ndarray]]) -> np.ndarray:
    """Pairs (i, j), a row each, of a `left` and a `right` member whose sets link, as many as join all labels that links join.

    Every pair of different labels is counted on the sets that `members` gives, unless parity maps rule it
    out; a link makes one label of the two, so the pairs are one less than the labels at most.
    """
    out = [np.zeros((0, 2), np.int64)]
    label = label.copy()
    for i, found, apart in near_sides(doc, label, size, maps, left, right, once=True):
        # The closest first: what they link need not be counted again.
        found = found[np.argsort(apart, kind="stable")]
        many = 1
        while len(found):
            some, found = found[:many], found[many:]
            many = min(2 * many, COUNTED)
            mine, *theirs = members([i, *some.tolist()])
            sizes = np.array([len(x) for x in theirs])
            flat = np.concatenate(theirs)
            same = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
            common = np.add.reduceat(same, np.cumsum(sizes) - sizes, dtype=np.int64)
            some = some[100 * common >= PERCENT * (len(mine) + sizes - common)]
            if len(some):
                some = some[np.unique(label[some], return_index=True)[1]]
                label[np.isin(label, label[some])] = label[i]
                out.append(np.stack([np.full(len(some), i), some], axis=1))
                found = found[label[found] != label[i]]
    return np.concatenate(out)


def proposals(*members) -> list[tuple[int, int]]:
    """The pairs of proposed_sides() as tuples."""
    return [(i, j) for i, j in proposed_sides(*members).tolist()]


PROFILE = "doc_id long, n_shingles long, print_high long, print_low long, parity binary, often array<long>, counts array<int>"


def profiles(docs: DataFrame) -> DataFrame:
    """Each document's set size, fingerprint and parity map; the first row of a slice also carries its frequent shingles."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, limit=2 * SLICE):
                sets, at = shingle_sets(data, offsets)
                sizes = np.diff(at)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sets)])
                other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(0x5851F42D4C957F2D)))])
                found, counts = np.unique(sets, return_counts=True)
                often = counts >= SLICE_OFTEN
                rows = [None] * len(sizes)
                tallies = [None] * len(sizes)
                rows[0], tallies[0] = found[often].view(np.int64), counts[often].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64)), pa.array((other[at[1:]] - other[at[:-1]]).view(np.int64)), pa.array(parities(sets, at), pa.binary()), pa.array(rows, pa.list_(pa.int64())), pa.array(tallies, pa.list_(pa.int32()))],
                    names=["doc_id", "n_shingles", "print_high", "print_low", "parity", "often", "counts"],
                )

    return docs.select("doc_id", "text").mapInArrow(look, PROFILE)


POSTINGS = "key long, block int, doc_id long, n_shingles long"


def postings(docs: DataFrame, wanted: np.ndarray, small: int, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """The keys of each document: subset hashes of a small set, the rarest members of one that large sets can reach.

    Members are ordered by how frequent they are, in powers of two, then by hash. `frequent` is sorted;
    frequent[i] occurs about counts[i] times, and its list is dealt over blocks of BLOCK, from 1 on; a list
    that stays whole is block 0. `wanted` maps the documents that stand for a set;
    a copy that slips through only makes its links twice.
    """

    tiers = np.append(np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, 0)
    blocks = (counts // BLOCK + 1).astype(np.uint64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted[batch.column(2).to_numpy()]))
            for part, data, offsets in chunks(batch, limit=2 * SLICE):
                sets, at = shingle_sets(data, offsets)
                sizes = np.diff(at)
                place = np.minimum(np.searchsorted(frequent, sets), max(0, len(frequent) - 1))
                known = (frequent[place] == sets) if len(frequent) else np.zeros(len(sets), bool)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((sets, np.where(known, tiers[place], 0), owner))
                rank = np.arange(len(sets)) - np.repeat(at[:-1], sizes)
                lengths = sizes - -(-PERCENT * sizes // 100) + 1
                lengths[100 * sizes // PERCENT <= small] = 0
                taken = order[rank < np.repeat(lengths, sizes)]
                docs_ = part.column(0).to_numpy(zero_copy_only=False)
                key, who, block = sets[taken], owner[taken], np.zeros(len(taken), np.int32)
                hot = known[taken]
                several = blocks[place[taken[hot]]]
                block[hot] = np.where(several > 1, mix(docs_[who[hot]].astype(np.uint64)) % several + np.uint64(1), 0)
                more_keys, more_who = [], []
                for i in np.flatnonzero((sizes > 0) & (sizes <= small)).tolist():
                    members = sets[at[i] : at[i + 1]]
                    for c in subset_sizes(len(members)):
                        chosen = np.array(list(itertools.combinations(range(len(members)), c)), np.int64)
                        made = mix(mix(members[chosen]).sum(axis=1, dtype=np.uint64) + np.uint64(c << 8))
                        more_keys.append(made)
                        more_who.append(np.full(len(made), i))
                if more_keys:
                    key, who = np.concatenate([key, *more_keys]), np.concatenate([who, *more_who])
                    block = np.concatenate([block, np.zeros(len(key) - len(block), np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(block), pa.array(docs_[who], pa.int64()), pa.array(sizes[who])], names=["key", "block", "doc_id", "n_shingles"])

    slot = F.pmod(F.xxhash64("doc_id"), F.lit(len(wanted)))
    return docs.select("doc_id", "text", slot.alias("slot")).mapInArrow(keys, POSTINGS)


STARS = "star long, doc_id long, n_shingles long"


def stars(posted: DataFrame) -> DataFrame:
    """(star, doc_id, n_shingles): documents that share a list are in one star, named by the list's first document.

    Near copies share most of their lists and these mostly have the same first document, so a star's
    rows are far fewer than its lists'. A list dealt over blocks is a star named by its key.
    """
    dealt = posted.repartition(partitions(posted.sparkSession), "key", "block").sortWithinPartitions("key", "block", "n_shingles", "doc_id")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The block in hand: its key, its first document and that one's size.
        state = (None, None, 0, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, block, doc, size = (batch.column(i).to_numpy() for i in range(4))
            new = np.ones(n, bool)
            new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            new[0] = (key[0], block[0]) != state[:2]
            heads = np.flatnonzero(new)
            group = np.cumsum(new) - 1 + (not new[0])
            first, least = (x[heads] if new[0] else np.concatenate([[y], x[heads]]) for x, y in ((doc, state[2]), (size, state[3])))
            state = (key[-1], block[-1], int(first[group[-1]]), int(least[group[-1]]))
            hot, follows = block > 0, ~new & (block == 0)
            named, sized = first[group[follows]], least[group[follows]]
            rows = np.stack([np.concatenate([key[hot], named, named]), np.concatenate([doc[hot], doc[follows], named]), np.concatenate([size[hot], size[follows], sized])])
            rows = rows[:, np.lexsort(rows)]
            rows = rows[:, np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0))] if rows.size else rows
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["star", "doc_id", "n_shingles"])

    return dealt.mapInArrow(lead, STARS).distinct()


def spread(joined: DataFrame) -> DataFrame:
    """Rows (star, cell, doc_id, component, left, right): within each cell, `left` members are to be compared with `right` ones.

    `joined` has star, doc_id, component and n_shingles. Stars of one component are left out. Of two members in
    different components one is not in the star's largest component; such members are the left ones.
    A star of more than TILE members or SHINGLES shingles is cut into cells: each block of its left members meets each block of all.
    """
    parts = joined.groupBy("star", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("load"))
    heads = parts.groupBy("star").agg(F.sum("n").alias("n"), F.sum("load").alias("load"), F.max(F.struct("n", "component", "load")).alias("top")).filter(F.col("n") > F.col("top.n"))
    tiles = F.ceil(F.greatest(F.col("n") / TILE, F.col("load") / SHINGLES))
    blocks = F.ceil(F.greatest((F.col("n") - F.col("top.n")) / TILE, (F.col("load") - F.col("top.load")) / SHINGLES))
    minor = F.col("component") != F.col("top.component")
    here = F.pmod(F.xxhash64("doc_id"), F.col("tiles"))
    block = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("blocks"))
    cell = lambda c, left, right: F.struct(c.cast("long").alias("cell"), left.alias("left"), right.alias("right"))
    yes, no = F.lit(True), F.lit(False)
    one = F.array(cell(F.lit(0), F.col("minor"), yes))
    rights = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: cell(b * F.col("tiles") + here, no, yes))
    lefts = F.when(F.col("minor"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: cell(block * F.col("tiles") + t, yes, no))).otherwise(F.array().cast("array<struct<cell:bigint,left:boolean,right:boolean>>"))
    rows = joined.join(heads, "star").select("star", "doc_id", "component", minor.alias("minor"), tiles.alias("tiles"), blocks.alias("blocks"))
    return rows.select("star", "doc_id", "component", F.explode(F.when(F.col("tiles") == 1, one).otherwise(F.concat(rights, lefts))).alias("c")).select("star", "c.cell", "doc_id", "component", "c.left", "c.right")


def first_cells(starred: DataFrame) -> DataFrame:
    """The rows of spread() before any link is known: a large star is cut into cells that all hold its first member."""
    heads = starred.groupBy("star").agg(F.count("*").alias("n"), F.min(F.struct("n_shingles", "doc_id")).alias("top")).filter("n > 1").withColumn("tiles", F.ceil(F.col("n") / TILE))
    rows = starred.join(heads.select("star", "tiles"), "star").select("star", F.pmod(F.xxhash64("doc_id"), "tiles").alias("cell"), "doc_id", F.col("doc_id").alias("component"), F.lit(True).alias("left"), F.lit(True).alias("right"))
    tops = heads.filter("tiles > 1").select("star", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("cell"), F.col("top.doc_id").alias("doc_id"), F.col("top.doc_id").alias("component"), F.lit(True).alias("left"), F.lit(False).alias("right"))
    return rows.unionByName(tops)


def by_cell(dealt: DataFrame, made: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """What `made` makes of the rows of each cell that has several; `dealt` has star and cell first and is sorted by them."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows of the cell in hand, which may go on in the next batch.
        kept: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            star, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            begins = np.flatnonzero(np.append(True, (star[1:] != star[:-1]) | (cell[1:] != cell[:-1])))
            out = []
            for x, y in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows]):
                if (star[x], cell[x]) != last:
                    if sum(p.num_rows for p in kept) > 1:
                        out.append(made(pa.Table.from_batches(kept)))
                    kept, last = [], (star[x], cell[x])
                kept.append(batch.slice(x, y - x))
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches(max_chunksize=1 << 30)[0] if sum(p.num_rows for p in out) else out[0]
        if sum(p.num_rows for p in kept) > 1:
            yield made(pa.Table.from_batches(kept))

    return dealt.mapInArrow(walk, schema)


PROPOSED = "a long, b long, star long, component long"


def proposed(cells: DataFrame, maps: DataFrame, every: bool, partial: bool = False) -> DataFrame:
    """What the members of the cells propose, staged: rows with the pairs (a, b), a > b, and rows with the components of a star that are in a pair; see proposed_sides().

    Two members of a star whose components are in no pair of it cannot link. `partial` cells, those with members
    that are no right ones, do not meet all pairs of their star: all their components count.
    """
    rows = cells.join(maps, "doc_id").select("star", "cell", "n_shingles", "doc_id", "component", "left", "right", "parity")
    dealt = rows.repartition(partitions(cells.sparkSession), "star", "cell").sortWithinPartitions("star", "cell", "n_shingles", "doc_id")

    def made(table: pa.Table) -> pa.RecordBatch:
        size, doc, label, left, right = (table.column(i).to_numpy() for i in range(2, 7))
        sides = proposed_sides(doc, label, size, table.column(7).to_pylist(), left, right, every)
        pairs = doc[sides]
        met = np.unique(label if partial and not right.all() else label[sides])
        none = lambda n: pa.nulls(n, pa.int64())
        star = pa.array(np.full(len(met), table.column(0)[0].as_py()), pa.int64())
        columns = ((pa.array(pairs.max(axis=1)), none(len(met))), (pa.array(pairs.min(axis=1)), none(len(met))), (none(len(pairs)), star), (none(len(pairs)), pa.array(met)))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["a", "b", "star", "component"])

    return stage(by_cell(dealt, made, PROPOSED), "proposals")


def described(texts: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, parity, body) of the rows of bodies() that have a word."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            raw = pa.array([press.decompress(x.as_buffer()) for x in batch.column(1)], pa.large_binary())
            for part, data, offsets in chunks(batch.append_column("text", raw), limit=2 * SLICE):
                sets, at = shingle_sets(data, offsets)
                made = pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(parities(sets, at), pa.binary()), part.column(1)], names=["doc_id", "n_shingles", "parity", "body"])
                yield made.filter(pa.array(np.diff(at) > 0))

    return texts.select("id", "body").mapInArrow(look, "doc_id long, n_shingles long, parity binary, body binary")


def linked(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b) of the cells, as many as join all components that links of their members join; see linked_sides().

    Pairs are counted where the members meet, so a cell gives fewer rows than it has members, however many pairs
    may link. `known` has the rows of described().
    """
    rows = cells.join(known, "doc_id").select("star", "cell", "n_shingles", "doc_id", "component", "left", "right", "parity", "body")
    dealt = rows.repartition(partitions(cells.sparkSession), "star", "cell").sortWithinPartitions("star", "cell", "n_shingles", "doc_id")

    def made(table: pa.Table) -> pa.RecordBatch:
        size, doc, label, left, right = (table.column(i).to_numpy() for i in range(2, 7))
        press, body = zstandard.ZstdDecompressor(), table.column(8)
        sets: dict[int, np.ndarray] = {}

        def members(asked: list[int]) -> list[np.ndarray]:
            new = [i for i in asked if i not in sets]
            if new:
                texts = [press.decompress(body[i].as_buffer()) for i in new]
                every, at = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
                sets.update({i: every[x:y] for i, x, y in zip(new, at[:-1], at[1:])})
            return [sets[i] for i in asked]

        pairs = doc[linked_sides(doc, label, size, table.column(7).to_pylist(), left, right, members)]
        return pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], names=["a", "b"])

    return by_cell(dealt, made, "a long, b long").distinct()


def bodies(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, body): the lower-cased texts, compressed, of the documents that `asked` names by doc_id (and of few others, by a clash in a map)."""
    wanted = bitmap(asked, F.xxhash64("doc_id"), map_bits(asked.count()))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        for batch in batches:
            batch = batch.filter(pa.array(wanted[batch.column(1).to_numpy()]))
            for part, data, offsets in chunks(batch, limit=2 * SLICE):
                raw, at = data.tobytes().lower(), offsets.tolist()
                packed = [press.compress(raw[a:b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["id", "body"])

    return docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(len(wanted))).alias("slot"), "text").mapInArrow(shrink, "id long, body binary")


def asked_texts(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of bodies() that `asked` names by id (and few others, by a clash in a map)."""
    wanted = bitmap(asked, F.xxhash64("id"), map_bits(asked.count()))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted[batch.column(2).to_numpy()])).select(["id", "body"])

    return texts.select("id", "body", F.pmod(F.xxhash64("id"), F.lit(len(wanted))).alias("slot")).mapInArrow(choose, "id long, body binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, counted on whole texts; texts that no pair names are not dealt out."""
    texts = asked_texts(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b").select("a", "b", "body_a", "body_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()

        def linked(texts: list[bytes], sides: list[tuple[int, int]]) -> list[bool]:
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            sets, at = shingle_sets(data, offsets)
            out = []
            for x, y in sides:
                mine, theirs = sets[at[x] : at[x + 1]], sets[at[y] : at[y + 1]]
                common = len(np.intersect1d(mine, theirs, assume_unique=True))
                out.append(common > 0 and 100 * common >= PERCENT * (len(mine) + len(theirs) - common))
            return out

        for batch in batches:
            keep: list[bool] = []
            # The texts in hand, the pairs' places there, and the last b's.
            texts, sides, held, last = [], [], 0, None
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                y = y.as_buffer()
                if last is None or last[0] != b or last[1] != y:
                    texts.append(press.decompress(y))
                    held += len(texts[-1])
                    last = (b, y, len(texts) - 1)
                texts.append(press.decompress(x.as_buffer()))
                held += len(texts[-1])
                sides.append((len(texts) - 1, last[2]))
                if held > SLICE:
                    keep += linked(texts, sides)
                    texts, sides, held, last = [], [], 0, None
            if sides:
                keep += linked(texts, sides)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable by links, for each id in a link.

    Alternates two rounds of joins by the larger and the smaller neighbours (large-star, small-star)
    until no edge changes; stars that remain are the components.
    """
    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before, now = None, state(edges)
    while before != now:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        new = stage(small, "edges")
        discard(edges)
        edges, before, now = new, now, state(new)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def _stars(joined: DataFrame) -> DataFrame:
    """Links that say the same as components do."""
    return joined.filter("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))


def unsettled(starred: DataFrame, joined: DataFrame, made: DataFrame) -> DataFrame:
    """(star, doc_id, component), staged: of the stars that have members in different components those whose components were in a pair; the others have nothing more to propose."""
    labels = joined.select(F.col("id").alias("doc_id"), "component")
    before = starred if "component" in starred.columns else starred.withColumn("component", F.col("doc_id"))
    open_ = before.join(made.filter("star IS NOT NULL").select("star", "component"), ["star", "component"], "left_semi").select("star", "doc_id").distinct()
    labelled = stage(open_.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "labelled")
    several = labelled.groupBy("star").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("star")
    out = stage(labelled.join(several, "star", "left_semi"), "stars")
    discard(labelled)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Equal sets are joined by their 128-bit fingerprints, and one document stands for them. Small sets post
    all their subsets of the fixed sizes that a link needs, large sets their rarest members; both
    meet in inverted lists, whose members make stars. Members of a star in different components
    are compared by their parity maps, which never rule out a link: first each star proposes a forest of
    links, and proposed pairs are counted on whole texts. Then, what is joined being left out, the texts of the
    open stars meet in their cells, where every pair that may link is counted unless its members are
    joined by then; only links leave a cell. So no link is lost, a group of n near copies costs about n counts,
    and rows grow with the stars' members, not with their pairs.

    Shingles are 64-bit hashes: two different ones are taken for equal in one text of a million words
    among ten million or so.

    A null or wordless text has an empty set and links with nothing; very long ones are taken whole.
    Rows that repeat a doc_id share their component. A null doc_id links with nothing and has no component.
    An empty table gives no rows.
    """
    profile = stage(profiles(docs), "profiles")
    rows = profile.filter("doc_id IS NOT NULL AND n_shingles > 0")
    prints = ["n_shingles", "print_high", "print_low"]
    sets = rows.groupBy(*prints).agg(F.min("doc_id").alias("stands"))
    histogram, members, n_sets = {}, 0, 0
    tally = sets.groupBy(F.when(F.col("n_shingles") <= ENUMERABLE, F.col("n_shingles")).alias("size")).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("members"))
    for r in tally.collect():
        members, n_sets = members + r["members"], n_sets + r["n"]
        if r["size"] is not None:
            histogram[r["size"]] = r["n"]
    often = (
        profile.filter("often IS NOT NULL").select(F.explode(F.arrays_zip("often", "counts")).alias("o")).groupBy("o.often").agg(F.sum("o.counts").alias("n"))
        .filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "often").limit(FREQUENT).toPandas()
    )
    frequent = often["often"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(frequent)
    counts = often["n"].to_numpy(np.int64)[order]
    # Rows that a list holds beside a member's own, on average over all members.
    small = boundary(histogram, float((counts * (counts - 1.0)).sum()) / max(1, members))
    texts = docs.filter("doc_id IS NOT NULL")
    stand = bitmap(sets, F.xxhash64("stands"), map_bits(n_sets))
    starred = stage(stars(postings(texts, stand, small, frequent[order], counts)), "stars")
    maps = rows.select("doc_id", "n_shingles", "parity")
    packed = stage(bodies(texts, starred), "bodies")
    made = proposed(first_cells(starred), maps, False, partial=True)
    pairs = stage(made.filter("a IS NOT NULL").select("a", "b").distinct(), "pairs")
    links = stage(verified(pairs, packed), "links")
    joined = stage(components(links), "components")
    left = unsettled(starred, joined, made)
    discard(starred, made, pairs, links)
    known = stage(described(asked_texts(packed, left.select(F.col("doc_id").alias("id")).distinct())), "open")
    sizes = known.groupBy("doc_id").agg(F.sum("n_shingles").alias("n_shingles"))
    links = stage(linked(spread(left.join(sizes, "doc_id")), known), "links")
    if not links.isEmpty():
        before, joined = joined, stage(components(_stars(joined).unionByName(links)), "components")
        discard(before)
    discard(left, known, links, packed)
    # A doc_id whose rows have several sets joins their groups.
    own = rows.join(sets, prints).select("doc_id", *prints, "stands")
    several = own.groupBy("doc_id").agg(F.min("stands").alias("a"), F.max("stands").alias("b"), F.collect_set("stands").alias("all")).filter("a < b")
    bridges = stage(several.select("a", F.explode("all").alias("b")).filter("a != b"), "bridges")
    if not bridges.isEmpty():
        joined = stage(components(_stars(joined).unionByName(bridges)), "components")
    found = profile.join(sets, prints, "left").join(joined, F.col("stands") == F.col("id"), "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("component", "stands"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, with its columns as they were: the one with the smallest doc_id.

    Of rows that repeat that doc_id one stays. Documents without a link, without words or without a doc_id stay.
    """
    kept_id, again = fresh(docs.columns, "kept_id", "again")
    found = near_duplicates(docs.select("doc_id", "text"))
    joined = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.max("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
    keep = joined.filter("doc_id = component_id").select(F.col("doc_id").alias(kept_id), ((F.col("n") > 1) & (F.col("n_shingles") > 0)).alias(again))
    kept = docs.join(keep, docs["doc_id"] == keep[kept_id]).drop(kept_id)
    # Rows that repeat a doc_id are few or none: only they are dealt out once more.
    once = kept.filter(~F.col(again)).drop(again)
    more = kept.filter(again).drop(again).dropDuplicates(["doc_id"])
    return once.unionByName(more).unionByName(docs.filter("doc_id IS NULL"))
