"""Spelling variants by a trie of letter counts.

Words are arranged by how often each of GROUPS groups of letters comes in them: the counts, one group after the other,
are a path in a trie, and words with equal counts share a leaf. A word that differs by one inserted, deleted or replaced
letter has at most one count one higher and at most one count one lower, so a depth-first search of the trie with a budget
of one surplus and one deficit meets all of them; the words of the leaves that it reaches are compared letter by letter.

The top of the trie is searched where the words lie. A node with more than a task's share of words is opened, others are
closed, and the opened nodes (at most OPENED * GROUPS numbers) go to all tasks. Each word goes to its own closed node and to the closed
nodes that its budget reaches, only upward in path order, so that each two words meet once. Below a closed node a task
builds the trie of the words that live there and searches it for these and for the visitors, a block of open branches at a
time. What leaves the task is, for each word, how many near words it met and the best of them. A node at full depth that is
still too large is cut into blocks of words: each of its words lives in one, visits those after it, and visitors see all.

The letters are dealt to the groups by how often they come in the words, so that groups are about equally filled.

Defined results: null text has no words; a null doc_id counts as an empty one; repeated rows count each; an empty table
gives no rows; other columns are ignored; words of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import cut, discard, prepare

#: A run of these is a word; all are one byte in ISO 8859-1, in the order of their code points.
LETTERS = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a letter.
SLIPS = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: Levels of the trie, four bits of a path each (higher counts are told apart at the leaves).
GROUPS, BITS = 15, 4
#: Words that live below a closed node, at least; it grows with the vocabulary so that no more than OPENED nodes of a level are open.
SHARE, OPENED = 4096, 40_000
#: Branches that a search follows at a time, and words of a branch that are compared without going deeper.
FRONT, FEW = 200_000, 2
#: Longer words are compared one pair at a time, without padding.
PADDED = 48

VISITS = "node long, block int, home boolean, path long, n long, word string"
MET = "word string, n long, n_near long, form string, form_n long"


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n: words of LEAST_LETTERS or more that come LEAST_COUNT times or more."""
    run = F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(LETTERS), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run)
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % SLIPS == 0, F.concat(F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


# ---------------------------------------------------------------- paths


def letter_groups(words: DataFrame) -> np.ndarray:
    """The group of each of the 256 letters: the commonest first, each to the group that has least so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            total += np.bincount(_letters(batch.column(0))[0], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], names=["letter", "n"])

    counts = np.zeros(256, np.int64)
    for r in words.select("word").mapInArrow(run, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect():
        counts[r.letter] = r.n
    group, filled = np.zeros(256, np.int64), np.zeros(GROUPS)
    for letter in np.argsort(-counts, kind="stable"):
        group[letter] = filled.argmin()
        filled[group[letter]] += counts[letter] + 1e-6
    return group


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words' letters, one byte each, and the n + 1 offsets of the words in them."""
    words = [w.encode("latin-1") for w in column.to_pylist()]
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=at[1:])
    return np.frombuffer(b"".join(words), np.uint8), at


def paths_of(letters: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Counts by group, the first one in the highest bits."""
    n = len(at) - 1
    own = np.repeat(np.arange(n), np.diff(at)) * GROUPS + group[letters]
    counts = np.minimum(np.bincount(own, minlength=n * GROUPS).reshape(n, GROUPS), (1 << BITS) - 1)
    return (counts << (BITS * np.arange(GROUPS)[::-1])).sum(axis=1)


def _with_paths(words: DataFrame, group: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths_of(*_letters(batch.column(0)), group))], names=["word", "n", "path"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, path long")


def _node(path: Column, depth: int) -> Column:
    """The node of a path at a depth: a one, then the path's first counts."""
    return F.shiftright(path, BITS * (GROUPS - depth)).bitwiseOR(F.lit(1 << BITS * depth))


def opened_nodes(words: DataFrame, share: int) -> tuple[list[np.ndarray], dict[int, int]]:
    """For each depth the sorted nodes with more than share words; for those at full depth their count of blocks."""
    kinds = words.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    nodes = kinds.select("n", F.explode(F.array(*(_node(F.col("path"), k) for k in range(GROUPS + 1)))).alias("node"))
    large = nodes.groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") > share).toArrow()
    node, count = large["node"].to_numpy().astype(np.int64), large["n"].to_numpy()
    depth = np.searchsorted(1 << (BITS * np.arange(1, GROUPS + 1, dtype=np.int64)), node, "right")
    return [np.sort(node[depth == k]) for k in range(GROUPS)], {int(a): int(-(-b // share)) for a, b in zip(node[depth == GROUPS], count[depth == GROUPS], strict=True)}


def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x if len(sorted_values) else np.zeros(len(x), bool)


def reached(path: np.ndarray, opened: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, closed node, and whether it is the word's own: the nodes that a budget of one surplus and one deficit reaches, upward only."""
    of, node = np.arange(len(path)), np.ones(len(path), np.int64)
    more, less, home = np.zeros(len(path), bool), np.zeros(len(path), bool), np.ones(len(path), bool)
    found = []
    for depth in range(GROUPS + 1):
        goes_on = _in(opened[depth], node) if depth < GROUPS else np.zeros(len(node), bool)
        found.append((of[~goes_on], node[~goes_on], home[~goes_on]))
        of, node, more, less, home = (x[goes_on] for x in (of, node, more, less, home))
        if not len(of):
            break
        count = path[of] >> (BITS * (GROUPS - 1 - depth)) & ((1 << BITS) - 1)
        parts = []
        for step in (0, 1, -1):
            # the first difference goes upward: the words of the other node don't come here
            fits = np.ones(len(of), bool) if step == 0 else ~more & (count < (1 << BITS) - 1) if step > 0 else ~less & (count > 0) & ~home
            parts.append((of[fits], (node[fits] << BITS) + count[fits] + step, more[fits] | (step > 0), less[fits] | (step < 0), home[fits] & (step == 0)))
        of, node, more, less, home = (np.concatenate(x) for x in zip(*parts, strict=True))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def visits(words: DataFrame, opened: list[np.ndarray], blocks: dict[int, int]) -> DataFrame:
    """A row for each word and closed node that it lives in or visits; nodes cut into blocks take their visitors in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                of, node, home = reached(part.column(2).to_numpy(), opened)
                block = np.zeros(len(of), np.int32)
                for cut_node in np.unique(node[_in(np.array(sorted(blocks), np.int64), node)]):
                    many, here = blocks[int(cut_node)], np.flatnonzero(node == cut_node)
                    own = np.array([hash_block(w, many) for w in part.column(0).take(pa.array(of[here])).to_pylist()])
                    first = np.where(home[here], own, 0)  # a word that lives here visits the blocks after its own
                    again = np.repeat(here, many - first)
                    place = np.arange(len(again)) - np.repeat(np.cumsum(many - first) - (many - first), many - first) + np.repeat(first, many - first)
                    stays = np.ones(len(of), bool)
                    stays[here] = False
                    of, node = np.concatenate([of[stays], of[again]]), np.concatenate([node[stays], node[again]])
                    block = np.concatenate([block[stays], place.astype(np.int32)])
                    home = np.concatenate([home[stays], home[again] & (place == np.repeat(own, many - first))])
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(block), pa.array(home), part.column(2).take(take), part.column(1).take(take), part.column(0).take(take)], names=["node", "block", "home", "path", "n", "word"])

    return words.select("word", "n", "path").mapInArrow(run, VISITS)


def hash_block(word: str, many: int) -> int:
    value = 0
    for c in word.encode():
        value = (value * 1_000_003 + c + 1) % 2_147_483_647
    return value % many


# ---------------------------------------------------------------- below a closed node


class Trie:
    """Words in the order of their paths. A branch is a range of them; its children are told by the next count."""

    def __init__(self, path: np.ndarray):
        self.order = np.argsort(path, kind="stable")
        self.path = path[self.order]

    def search(self, path: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a searching word and a word of a leaf that its budget reaches. All paths below are of nodes at this depth."""
        top = BITS * (GROUPS - depth)
        more, less = self._spent(path >> top, int(self.path[0] >> top), depth)
        n = len(path)
        stack = [(depth, np.arange(n), np.zeros(n, np.int64), np.full(n, len(self.path)), more, less)]
        while stack:  # the deepest branches first
            depth, of, low, high, more, less = stack.pop()
            if len(of) > FRONT:
                stack += [(depth, *(x[k : k + FRONT] for x in (of, low, high, more, less))) for k in range(0, len(of), FRONT)]
                continue
            leaf = (high - low <= FEW) | (depth == GROUPS)
            if leaf.any():
                yield from self._leaf_pairs(of[leaf], low[leaf], high[leaf])
            inner = ~leaf
            if not inner.any():
                continue
            of, low, high, more, less = (x[inner] for x in (of, low, high, more, less))
            shift = BITS * (GROUPS - 1 - depth)
            own = path[of] >> shift & ((1 << BITS) - 1)
            base = self.path[low] >> (shift + BITS) << BITS
            parts = []
            for step in (-1, 0, 1):
                fits = np.ones(len(of), bool) if step == 0 else ~more & (own < (1 << BITS) - 1) if step > 0 else ~less & (own > 0)
                child = base[fits] + own[fits] + step
                a, b = np.searchsorted(self.path, child << shift), np.searchsorted(self.path, (child + 1) << shift)
                some = np.flatnonzero(fits)[b > a]
                parts.append((of[some], a[b > a], b[b > a], more[some] | (step > 0), less[some] | (step < 0)))
            stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))

    @staticmethod
    def _spent(prefix: np.ndarray, node: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        more, less = np.zeros(len(prefix), bool), np.zeros(len(prefix), bool)
        for k in range(depth):
            step = (node >> BITS * k & ((1 << BITS) - 1)) - (prefix >> BITS * k & ((1 << BITS) - 1))
            more, less = more | (step > 0), less | (step < 0)
        return more, less

    def _leaf_pairs(self, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = high - low
        edge = 0
        total = np.cumsum(size)
        while edge < len(of):  # blocks of FRONT pairs; a longer list alone is met in pieces
            stop = max(edge + 1, int(np.searchsorted(total, (total[edge - 1] if edge else 0) + FRONT, "right")))
            many = size[edge:stop]
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            a, b = np.repeat(of[edge:stop], many), self.order[np.repeat(low[edge:stop], many) + place]
            for k in range(0, len(a), FRONT):
                yield a[k : k + FRONT], b[k : k + FRONT]
            edge = stop


def one_edit(left: bytes, right: bytes) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(left) > len(right):
        left, right = right, left
    if len(right) - len(left) > 1 or left == right:
        return False
    same = 0
    while same < len(left) and left[same] == right[same]:
        same += 1
    return left[same + (len(left) == len(right)) :] == right[same + 1 :]


class Spellings:
    """Words' letters, padded to one width, so that many pairs are compared at once."""

    def __init__(self, words: list[bytes]):
        self.words, self.size = words, np.array([len(w) for w in words], np.int64)
        width = min(int(self.size.max(initial=0)), PADDED) + 2
        self.letters = np.zeros((len(words), width), np.uint8)
        for k, w in enumerate(words):
            if len(w) <= PADDED:
                self.letters[k, 1 : len(w) + 1] = np.frombuffer(w, np.uint8)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair, whether the words differ by exactly one letter."""
        gap = self.size[b] - self.size[a]
        out = np.zeros(len(a), bool)
        long = np.maximum(self.size[a], self.size[b]) > PADDED
        for k in np.flatnonzero(long & (np.abs(gap) <= 1)):
            out[k] = one_edit(self.words[a[k]], self.words[b[k]])
        same = np.flatnonzero((gap == 0) & ~long)
        out[same] = (self.letters[a[same]] != self.letters[b[same]]).sum(axis=1) == 1
        one = np.flatnonzero((np.abs(gap) == 1) & ~long)
        short, tall = self.letters[np.where(gap[one] > 0, a[one], b[one])], self.letters[np.where(gap[one] > 0, b[one], a[one])]
        ahead, behind = short != tall, short[:, :-1] != tall[:, 1:]  # each letter against the one at its place, and the one after
        first = ahead.argmax(axis=1)
        last = np.where(behind.any(axis=1), behind.shape[1] - 1 - behind[:, ::-1].argmax(axis=1), -1)
        out[one] = last < first
        return out


def met_words(key: tuple, rows: pa.Table) -> pa.Table:
    """For each word that met near ones below this node: how many, and the best (of largest n, then the least)."""
    rows = rows.combine_chunks()
    node, _ = (k.as_py() for k in key)
    home = rows["home"].to_numpy(zero_copy_only=False).astype(bool)
    own = np.flatnonzero(home)
    none = pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "n_near": pa.array([], pa.int64()), "form": pa.array([], pa.string()), "form_n": pa.array([], pa.int64())})
    if not len(own):
        return none
    depth = (node.bit_length() - 1) // BITS
    path, n = rows["path"].to_numpy(), rows["n"].to_numpy()
    words = [w.encode("latin-1") for w in rows["word"].to_pylist()]
    spelt = Spellings(words)
    rank = np.empty(len(words), np.int64)  # by n from the largest, then by letters
    rank[sorted(range(len(words)), key=lambda k: (-n[k], words[k]))] = np.arange(len(words))
    trie = Trie(path[own])
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    for a, b in trie.search(path, depth):
        b = own[b]
        wanted = ~home[a] | (a < b)  # of two that live here, one search counts for both
        a, b = a[wanted], b[wanted]
        fits = spelt.near(a, b)
        a, b = a[fits], b[fits]
        near += np.bincount(a, minlength=len(words)) + np.bincount(b, minlength=len(words))
        np.minimum.at(best, a, rank[b])
        np.minimum.at(best, b, rank[a])
    told = np.flatnonzero(near)
    if not len(told):
        return none
    back = np.empty(len(words), np.int64)
    back[rank] = np.arange(len(words))
    form = pa.array(back[best[told]])
    return pa.table({"word": rows["word"].take(pa.array(told)), "n": rows["n"].take(pa.array(told)), "n_near": pa.array(near[told]), "form": rows["word"].take(form), "form_n": rows["n"].take(form)})


# ---------------------------------------------------------------- forms and roots


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds root to word, form: from each word along its forms to the last. Each round doubles the steps taken.

    A form is twice as common at least, so there are no rings, and a way has fewer steps than a count has bits.
    """
    reach = cut(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        onward = reach.filter("root <> word").select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = reach.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        older, moved = reach, cut(moved)
        discard(older)
        reach = moved
        if not moved.filter("moved").limit(1).count():
            return forms.join(reach.select("word", "root"), "word")


def group_spellings(docs: DataFrame, share: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the documents. share: words of a task's node, at least."""
    prepare(docs.sparkSession)
    counted = cut(counted_words(docs))
    words = cut(_with_paths(counted, letter_groups(counted)))
    discard(counted)
    total = words.count()
    opened, blocks = opened_nodes(words, share or max(SHARE, -(-total // OPENED)))
    met = visits(words, opened, blocks).groupBy("node", "block").applyInArrow(met_words, MET)
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), F.col("form"))).alias("best")
    found = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    near = words.select("word", "n").join(found, "word", "left")
    fits = F.col("best.form_n") >= 2 * F.col("n")
    forms = cut(near.select("word", F.when(fits, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.form_n")).alias("form_n")))
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
