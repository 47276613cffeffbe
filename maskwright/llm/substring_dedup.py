"""Near-duplicate passages by compact windows.

1. For each of HASHES hash functions a Cartesian tree is built over the min-hashes of a text's word shingles: the least
shingle c of a span [l, r] stands for all subsequences of it that contain c, and the spans left and right of c follow.
Only spans of ``least`` words or more are kept: compact windows (l, c, r), about 2 n / least a hash.
2. A window is filed under the shingles that follow c and those that precede it (CONTEXT of them). Of two equal passages
of the wanted length, each hash has the same least shingle, and one side of it lies within the passage. A task first joins
the windows of its own rows, so that a passage which very many documents hold is dealt out once a task.
3. Windows of a group are joined where their spans around c overlap by ``least`` words: a span allows passages that begin
from one place to another before c, and for each such place the first window that allows it is a head, to which the others
that allow it are joined. A head stands for all places of its document in the group. A window that differs from its head
some way (DEEPER shingles) from c may share more with another one: it is filed once more under that many shingles, in a
second round. Pairs of documents that meet under ENOUGH hash functions are candidates: one, as the heads that stand for a
passage under different hashes may belong to different documents, so that two votes for one pair can't be asked for.
4. Candidates are verified on their words around the windows: passages of ``least`` words or more whose shingle sets have
a similarity of ``percent`` or more, also within a looser alignment.

No pairs within a group are made: a passage that n documents hold gives n - 1 rows, each with an earlier document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm import textkit
from maskwright.llm.shared import cut, id_filter, passes, text_of

HASHES, ENOUGH, CONTEXT, SIZE = 3, 1, 12, 5
DEEPER = (18, 24, 30, 36, 42)
LEAST_WORDS, PERCENT = 50, 75
BLOCK_ROWS, REPEATED = 1 << 18, 8
_RANDOM = np.random.default_rng(5)
_XOR = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_FACTOR = _RANDOM.integers(0, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BACK = np.uint64(pow(int(textkit._BASE), -1, 1 << 64))


class _Least:
    """The first least place of any span, by the least places of blocks of SPAN and of 2, 4, 8 .. blocks: a span costs a look
    at two blocks and two table entries, however long it is."""

    SPAN, SHORT = 512, 2048

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        n = len(hashes) // self.SPAN
        level = hashes[: n * self.SPAN].reshape(n, self.SPAN).argmin(axis=1) + np.arange(n) * self.SPAN
        self.levels = [level]
        while len(level) > 1 << (len(self.levels) - 1):
            step = 1 << (len(self.levels) - 1)
            x, y = level[:-step], level[step:]
            level = np.where(hashes[y] < hashes[x], y, x)
            self.levels.append(level)

    def place(self, left: int, right: int) -> int:
        """In left .. right, both included, SHORT places apart or more."""
        h, span = self.hashes, self.SPAN
        first, last = -(-left // span), (right + 1) // span  # whole blocks first .. last - 1
        k = (last - first).bit_length() - 1
        some = [self.levels[k][first], self.levels[k][last - (1 << k)]]
        if left < first * span:
            some.append(left + h[left : first * span].argmin())
        if last * span <= right:
            some.append(last * span + h[last * span : right + 1].argmin())
        return int(min(some, key=lambda i: (h[i], i)))


def compact_windows(hashes: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(l, c, r) for each node of the Cartesian tree whose span l..r (both included) has ``least`` places or more; of equal
    hashes the first is the least. From left to right along each right spine, so that equal neighbours follow each other."""
    lowest, stack = None, [(0, len(hashes) - 1)] if len(hashes) >= least else []
    while stack:
        left, right = stack.pop()
        if right - left < _Least.SHORT:
            c = left + int(hashes[left : right + 1].argmin())
        else:
            lowest = lowest or _Least(hashes)
            c = lowest.place(left, right)
        yield left, c, right
        if c - left >= least:
            stack.append((left, c - 1))
        if right - c >= least:
            stack.append((c + 1, right))


def _contexts(values: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size, the hash of that many shingles from each place on (by prefix sums; places too near the end are cut off)."""
    n = len(values)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, textkit._BASE)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BACK)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * power[:n], dtype=np.uint64)])
    return [textkit.mix((sums[k:] - sums[:-k]) * back[: n - k + 1]) if n >= k else np.zeros(0, np.uint64) for k in sizes]


def _filed(w: textkit.Words, ids: np.ndarray, least: int):
    """Columns key, id, c, left, right, mask, deep of the windows of a slice, under both sides; the i-th 12 bits of deep are a
    hash of DEEPER[i] shingles on that side, 0 if the text ends before."""
    values, bounds = textkit.shingles(w, SIZE)
    ahead, *deeper = _contexts(values, (CONTEXT, *DEEPER))
    deeper = [(x % np.uint64(4095)).astype(np.int64) + 1 for x in deeper]
    hashed = [((values ^ x) * f) >> np.uint64(32) for x, f in zip(_XOR, _FACTOR)]
    hashed = [h.astype(np.uint32) for h in hashed]
    places: list[int] = []
    rest: list[list[int]] = []
    documents, counts = np.flatnonzero(np.diff(bounds) >= least), []
    for d in documents:
        a, b = int(bounds[d]), int(bounds[d + 1])
        found: dict[int, list[int]] = {}
        for j, h in enumerate(hashed):
            # where a text goes on repeating a few words, equal least shingles with equal shingles after them follow each
            # other at once, and every window but the last begins further left: one in REPEATED places is enough
            before: dict[int, int] = {}
            for left, c, right in compact_windows(h[a:b], least):
                if left and h[a + left - 1] == h[a + c] and a + c < len(ahead):
                    context = int(ahead[a + c])
                    if 0 < c - before.get(context, -REPEATED) < REPEATED:
                        continue
                    if len(before) > 64:
                        before.clear()
                    before[context] = c
                had = found.get(c)
                if had is None:
                    found[c] = [c - left, right - c, 1 << j]
                else:
                    had[0], had[1], had[2] = max(had[0], c - left), max(had[1], right - c), had[2] | 1 << j
        places += found
        rest += found.values()
        counts.append(len(found))
    if not places:
        return np.zeros((0, 7), np.int64)
    c, spans = np.array(places), np.array(rest, np.int64)
    low, high, own = (np.repeat(x, counts) for x in (bounds[documents], bounds[documents + 1], ids[documents]))
    rows: list[np.ndarray] = []
    for side in (0, 1):
        at = low + c - side * (CONTEXT - 1)
        ok = np.flatnonzero((at >= low) & (at + CONTEXT <= high))
        key = textkit.mix(ahead[at[ok]] + np.uint64(side + 1)).view(np.int64)
        deep = np.zeros(len(key), np.int64)
        for i, size in enumerate(DEEPER):
            at = (low + c)[ok] - side * (size - 1)
            whole = np.flatnonzero((at >= low[ok]) & (at + size <= high[ok]))
            deep[whole] |= deeper[i][at[whole]] << 12 * i
        rows.append(np.column_stack([key, own[ok], c[ok], spans[ok], deep]))
    return np.concatenate(rows)


_DEALT = "key long, id long, c int, left int, right int, mask int, deep long, id2 long, c2 int"
_DEALT_ARROW = pa.schema([("key", pa.int64()), ("id", pa.int64()), *[(n, pa.int32()) for n in ("c", "left", "right", "mask")], ("deep", pa.int64()), ("id2", pa.int64()), ("c2", pa.int32())])
_LATER = -1  # deep of rows filed for the second round


def _heads(keys: np.ndarray) -> np.ndarray:
    """For each place of sorted keys, the first place of its key."""
    start = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.maximum.accumulate(np.where(start, np.arange(len(keys)), 0))


def _allowed(rows: np.ndarray, least: int) -> np.ndarray:
    """For each hash of a row, bits of how far before c a passage of ``least`` shingles may begin. Two spans overlap by
    ``least`` where they have a bit in common (beyond 64 shingles, where they may)."""
    scale = max(64, least)
    low, high = (np.clip(x, 0, least - 1) * 64 // scale for x in (least - 1 - rows[:, 4], rows[:, 3]))
    one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    bits = (full >> (np.uint64(63) - high.astype(np.uint64))) & ~((one << low.astype(np.uint64)) - one)
    return np.where((rows[:, 5][:, None] >> np.arange(HASHES)) & 1 > 0, bits[:, None], np.uint64(0))


def _grouped(rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, head, kept) of rows sorted by key, id, c: places of links, and which rows stand for the others.

    Each bit that a row allows is that of some head: the first row of the key that allows it."""
    kept = np.zeros(len(rows), bool)
    allowed = _allowed(rows, least)
    other = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    start = np.flatnonzero(np.concatenate([[True], other])) if len(rows) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(rows)) - 1
    own = np.searchsorted(start, np.arange(len(rows)), side="right") - 1
    left, links, heads = np.arange(len(rows)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left):
        head = left[_heads(rows[left, 0])]
        kept[head] = True
        link = ((allowed[left] & allowed[head]) > 0).any(axis=1) & (own[left] != own[head])
        links.append(left[link])
        heads.append(head[link])
        # what a head covers is covered for all rows of the key
        mine = allowed[head]
        allowed[left] &= ~mine
        left = left[allowed[left].any(axis=1)]
    link, head = np.concatenate(links), np.concatenate(heads)
    # all places of the head's document in the group, by the first and the last of them
    first, last = start[own], end[own]
    many = kept & (first < last)
    kept[first[many]] = kept[last[many]] = True
    more = first[head] < last[head]
    return np.concatenate([link, link[more]]), np.concatenate([first[head], last[head][more]]), kept


def _later(rows: np.ndarray, link: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Rows for the second round: those linked to a head, once for each of DEEPER by which they differ from it."""
    out = []
    for i in range(len(DEEPER)):
        mine, its = (rows[x, 6] >> 12 * i & 4095 for x in (link, head))
        some = np.unique(link[(mine != its) & (mine > 0)])
        more = rows[some]
        upto = (rows[some, 6] & ((1 << 12 * (i + 1)) - 1)).astype(np.uint64)
        more[:, 0] = textkit.mix(rows[some, 0].astype(np.uint64) + textkit.mix(upto + np.uint64(i + 1 << 60))).view(np.int64)
        more[:, 6] = _LATER
        out.append(more)
    return np.concatenate(out)


def _local(rows: np.ndarray, least: int):
    """(rows to be dealt, links): a row whose places other rows of this block allow goes on as a link, or not at all."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    link, head, kept = _grouped(rows, least)
    return np.concatenate([rows[kept], _later(rows, link, head)]), rows[link], rows[head]


def _batch(dealt: np.ndarray, link: np.ndarray, head: np.ndarray) -> pa.RecordBatch:
    n, m = len(dealt), len(link)
    # links only pass through the next step: they are spread evenly
    key = np.concatenate([dealt[:, 0], textkit.mix((link[:, 1] * 31 + link[:, 2]).astype(np.uint64)).view(np.int64)])
    both = np.concatenate([dealt, link])
    mask = np.concatenate([dealt[:, 5], link[:, 5] & head[:, 5]])
    blank = np.arange(n + m) < n
    arrays = [key, both[:, 1], *[x.astype(np.int32) for x in (both[:, 2], both[:, 3], both[:, 4], mask)], np.concatenate([dealt[:, 6], np.zeros(m, np.int64)])]
    columns = [pa.array(x) for x in arrays]
    columns.append(pa.array(np.concatenate([np.zeros(n, np.int64), head[:, 1]]), mask=blank))
    columns.append(pa.array(np.concatenate([np.zeros(n, np.int64), head[:, 2]]).astype(np.int32), mask=blank))
    return pa.RecordBatch.from_arrays(columns, schema=_DEALT_ARROW)


def _windows(least: int):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for w in textkit.words(batch.column(1)):
                rows = _filed(w, ids[w.first : w.first + len(w)], least)
                held.append(rows)
                size += len(rows)
                if size >= BLOCK_ROWS:
                    yield _batch(*_local(np.concatenate(held), least))
                    held, size = [], 0
        if size:
            yield _batch(*_local(np.concatenate(held), least))

    return run


def _split(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.RecordBatch]:
    """(rows, links) of a dealt batch."""
    known = batch.column("id2").is_valid()
    rows = batch.filter(pa.compute.invert(known))
    return np.column_stack([rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(7)]), batch.filter(known)


def _again(least: int):
    """The second round: the rows filed for it, joined within the task as windows are; links pass through."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            rows, links = _split(batch)
            yield links
            rows[:, 6] = 0
            held.append(rows)
            size += len(rows)
            if size >= BLOCK_ROWS:
                yield _batch(*_local(np.concatenate(held), least))
                held, size = [], 0
        if size:
            yield _batch(*_local(np.concatenate(held), least))

    return run


def _pairs(least: int):
    """Links, and rows for the second round, from rows sorted by key: only the heads of the present key are held."""

    def run(batches):
        held = np.zeros((0, 7), np.int64)
        for batch in batches:
            rows, links = _split(batch)
            yield links
            later = rows[:, 6] == _LATER
            own = np.concatenate([held, rows[~later]])
            link, head, kept = _grouped(own, least)
            new = (link >= len(held)) | (head >= len(held))
            link, head = link[new], head[new]
            yield _batch(np.concatenate([rows[later], _later(own, link, head)]), own[link], own[head])
            if len(own):
                held = own[kept & (own[:, 0] == own[-1, 0])]

    return run


def _word_lists(bits_sent, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            near = passes(bits_sent.value, ids)
            if not near.any():
                continue
            batch = batch.filter(pa.array(near))
            ids, out = ids[near], []
            for w in textkit.words(batch.column(1)):
                out += [{"id": int(ids[w.first + d]), "words": w.hash[w.bound[d] : w.bound[d + 1]].tobytes()} for d in range(len(w))]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each shingle of a, where b holds it, or -1. Where b has it several times, the place nearest to the shift of the
    last shingle before that b has once (else of the next one after, else none)."""
    order = np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b[order], a, side=side) for side in ("left", "right"))
    many = high - low
    place = np.full(len(a), -1)
    once = np.flatnonzero(many == 1)
    place[once] = order[low[once]]
    several = np.flatnonzero(many > 1)
    if not len(several):
        return place
    shift = np.zeros(len(several), np.int64)
    if len(once):
        shifts = place[once] - once
        shift = shifts[np.maximum(np.searchsorted(once, several, side="right") - 1, 0)]
    # places of b by value, then place: the nearest one to the place wanted lies beside it
    wide = np.int64(len(b) + 1)
    ranked = np.concatenate([[0], np.cumsum(b[order][1:] != b[order][:-1])]) * wide + order
    rank = ranked[low[several]] // wide
    wanted = np.clip(several + shift, 0, len(b) - 1)
    after = np.clip(np.searchsorted(ranked, rank * wide + wanted), low[several], high[several] - 1)
    before = np.maximum(after - 1, low[several])
    nearer = np.abs(order[before] - wanted) <= np.abs(order[after] - wanted)
    place[several] = order[np.where(nearer, before, after)]
    # a shingle of several places follows its neighbour's, or an equal passage would be torn there
    for i in several:
        if i and 0 <= place[i - 1] < len(b) - 1 and b[place[i - 1] + 1] == a[i]:
            place[i] = place[i - 1] + 1
    for i in several[::-1]:
        if i + 1 < len(a) and place[i + 1] > 0 and b[place[i + 1] - 1] == a[i] and not (i and place[i - 1] >= 0 and place[i] == place[i - 1] + 1):
            place[i] = place[i + 1] - 1
    return place


def _longest(at: np.ndarray, to: np.ndarray, least: int, percent: int) -> tuple[int, int] | None:
    """(first, last) of the longest stretch of matches that reaches percent and ``least`` shingles, by places: with m
    matches, (100 + percent) m >= percent * (places in both texts). None if there is none."""
    n = len(at)
    value = (100 + percent) * np.arange(n) - percent * (at + to)
    gain = 100 + percent - 2 * percent
    # the last match from which on the value is as high as wanted: by the highest value from each match on
    top = np.maximum.accumulate(value[::-1])[::-1]
    last = n - 1 - np.searchsorted(top[::-1], value - gain, side="left")
    length = np.minimum(at[last] - at, to[last] - to) + 1
    i = int(length.argmax())
    return (i, int(last[i])) if length[i] >= least else None


def passages(mine: np.ndarray, other: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """(start, end, other's start, other's end, similarity) in words: passages of ``mine`` that ``other`` holds too.

    A run of shared shingles that is less similar than ``percent`` is taken apart: its longest stretch that reaches
    percent is a passage, and so on with what lies on both sides of it."""
    from maskwright.llm.decontaminate import grams

    a, b = grams(mine, SIZE), grams(other, SIZE)
    place = _places(a, b)
    at = np.flatnonzero(place >= 0)
    out = []
    if not len(at):
        return out
    # a new passage begins after two edits' worth of strange shingles, or where the other text jumps as far
    jump = (np.diff(at) > 2 * SIZE + 2) | (np.abs(np.diff(place[at]) - np.diff(at)) > 2 * SIZE + 2)
    left = np.split(at, np.flatnonzero(jump) + 1)[::-1]
    while left:
        run = left.pop()
        if not len(run):
            continue
        start, end = int(run[0]), int(run[-1]) + SIZE
        low, high = int(place[run].min()), int(place[run].max()) + SIZE
        if end - start < least or high - low < least:
            continue
        s, t = np.unique(a[start : end - SIZE + 1]), np.unique(b[low : high - SIZE + 1])
        both = len(np.intersect1d(s, t, assume_unique=True))
        if 100 * both >= percent * (len(s) + len(t) - both):
            out.append((start, end, low, high, both / (len(s) + len(t) - both)))
            continue
        inner = _longest(run, place[run], least - SIZE + 1, percent)
        if inner and inner != (0, len(run) - 1):
            left += [run[inner[1] + 1 :], run[inner[0] : inner[1] + 1], run[: inner[0]]]
        elif inner or len(s) < end - start - SIZE + 1 or len(t) < high - low - SIZE + 1 or (np.diff(place[run]) < 1).any():
            # shingles that repeat or change places count otherwise in sets: parted at the worst gap
            worst = int((np.diff(run) + np.abs(np.diff(place[run]) - 1)).argmax()) + 1
            left += [run[worst:], run[:worst]]
    return out


_RESULT = "doc_id long, first_doc_id long, start_word int, end_word int, first_start_word int, first_end_word int, similarity double"


def _verify(least: int, percent: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, b = np.frombuffer(r["part"], np.uint64), np.frombuffer(r["part2"], np.uint64)
                for s, e, low, high, j in passages(a, b, least, percent):
                    out.append({"doc_id": r["id"], "first_doc_id": r["id2"], "start_word": r["at"] + s, "end_word": r["at"] + e, "first_start_word": r["at2"] + low, "first_end_word": r["at2"] + high, "similarity": j})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each passage of a document that an earlier one (by id) holds as well, equal or nearly so.

    ``doc_id, first_doc_id, start_word, end_word, first_start_word, first_end_word, similarity``: words are counted from
    0, ends exclusive. Of passages one within another the longest is reported; an equal one names the earliest document
    that holds it, another one the most similar that was met. Passages within one document are not reported. Null, empty
    and short texts have none; rows of a null id are left out; rows that repeat an id count as one document, each with its own words; other columns are
    not read; an empty table gives no rows.
    """
    least = least_words - SIZE + 1
    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), text_of(text).alias("text"))
    dealt = rows.mapInArrow(_windows(least), _DEALT).repartition("key").sortWithinPartitions("key", "id", "c")
    dealt = dealt.mapInArrow(_pairs(least), _DEALT).mapInArrow(_again(least), _DEALT).repartition("key").sortWithinPartitions("key", "id", "c")
    links = dealt.mapInArrow(_pairs(least), _DEALT).filter("id2 is not null")
    low, high = F.least("id", "id2"), F.greatest("id", "id2")
    mine, other = F.when(F.col("id") == high, F.col("c")).otherwise(F.col("c2")), F.when(F.col("id") == high, F.col("c2")).otherwise(F.col("c"))
    links = links.select(high.alias("id"), low.alias("id2"), mine.alias("c"), other.alias("c2"), "mask")
    pairs = links.groupBy("id", "id2").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.min("c2").alias("a2"), F.max("c2").alias("b2"), F.expr("bit_or(mask)").alias("mask"))
    pairs = pairs.filter(F.bit_count("mask") >= ENOUGH).drop("mask").withColumn("pair", F.monotonically_increasing_id())
    pairs = cut(pairs, "passage-pairs", batch_rows=2000)

    # an equal passage that went on for longer would hold another window of either document
    margin = least_words + CONTEXT + SIZE
    ends = pairs.select("pair", F.lit(0).alias("side"), "id", (F.col("a") - margin).alias("low"), (F.col("b") + margin).alias("high"))
    ends = ends.unionByName(pairs.select("pair", F.lit(1).alias("side"), F.col("id2").alias("id"), (F.col("a2") - margin).alias("low"), (F.col("b2") + margin).alias("high")))
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(ends.select("id")))
    lists = pa.schema([("id", pa.int64()), ("words", pa.binary())])
    words = rows.mapInArrow(_word_lists(bits, lists), "id long, words binary")
    at = F.greatest(F.col("low"), F.lit(0))
    part = F.substring("words", 8 * at + 1, 8 * (F.col("high") - at))
    parts = cut(words.join(ends, "id").select("pair", "side", at.alias("at"), part.alias("part")), "passage-parts", batch_rows=1000)
    both = pairs.select("pair", "id", "id2").join(parts.filter("side = 0").drop("side"), "pair").join(parts.filter("side = 1").select("pair", F.col("at").alias("at2"), F.col("part").alias("part2")), "pair")
    result = pa.schema([("doc_id", pa.int64()), ("first_doc_id", pa.int64()), *[(n, pa.int32()) for n in ("start_word", "end_word", "first_start_word", "first_end_word")], ("similarity", pa.float64())])
    found = both.select("id", "id2", "at", "part", "at2", "part2").mapInArrow(_verify(least_words, percent, result), _RESULT)
    found = cut(found, "passages", batch_rows=500)
    # a head may hold its part from an earlier document in turn, which stands for it: from the head of a task to that of
    # all tasks, and to that of another round
    for _ in range(2):
        found = _handed_on(found)
    return _joined_up(found)


def _joined_up(found: DataFrame) -> DataFrame:
    """Parts of one passage that were verified by themselves, as their windows met apart: equal ones of the same two
    documents that overlap at one shift become one. Of passages of a document that lie one within another the longest stays,
    of equal spans the most similar one, of these that of the first document."""
    exact = (F.col("similarity") == 1) & (F.col("end_word") - F.col("start_word") == F.col("first_end_word") - F.col("first_start_word"))
    # rows that aren't equal stay by themselves
    rows = found.distinct().withColumn("shift", F.when(exact, F.col("first_start_word") - F.col("start_word"))).withColumn("own", F.when(~exact, F.struct("start_word", "end_word", "first_start_word", "first_end_word")))
    chain = Window.partitionBy("doc_id", "first_doc_id", "shift", "own").orderBy("start_word", "end_word")
    rows = rows.withColumn("fresh", F.coalesce(F.col("start_word") > F.max("end_word").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    rows = rows.withColumn("part", F.sum(F.col("fresh").cast("int")).over(chain))
    ends = [F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("first_start_word").alias("first_start_word"), F.max("first_end_word").alias("first_end_word"), F.max("similarity").alias("similarity")]
    rows = rows.groupBy("doc_id", "first_doc_id", "shift", "own", "part").agg(*ends)
    wide = Window.partitionBy("doc_id").orderBy("start_word", F.desc("end_word"), F.desc("similarity"), "first_doc_id", "first_start_word", "first_end_word").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("upto", F.max("end_word").over(wide)).filter("upto is null or upto < end_word").select(*found.columns)


def _handed_on(found: DataFrame) -> DataFrame:
    """The rows; where a row's part of the earlier document lies within an equal passage that this one has from a still
    earlier document, that one (the first of these) takes its place."""
    equal = found.filter("similarity = 1 and end_word - start_word = first_end_word - first_start_word")
    up = equal.select(F.col("doc_id").alias("of"), F.col("start_word").alias("low"), F.col("end_word").alias("high"), F.col("first_doc_id").alias("to"), (F.col("first_start_word") - F.col("start_word")).alias("shift"))
    met = found.join(up, (F.col("first_doc_id") == F.col("of")) & (F.col("low") <= F.col("first_start_word")) & (F.col("high") >= F.col("first_end_word")), "left")
    one = met.groupBy(*found.columns).agg(F.min(F.when(F.col("to").isNotNull(), F.struct("to", "shift"))).alias("u"))
    shift = F.coalesce(F.col("u.shift"), F.lit(0))
    moved = {"first_doc_id": F.coalesce("u.to", "first_doc_id"), "first_start_word": F.col("first_start_word") + shift, "first_end_word": F.col("first_end_word") + shift}
    return one.withColumns(moved).select(*found.columns)
