"""Problem 4: mapping free-entered values to a canonical list with BK-trees.

The trees hold the entries' letters under the edit metric of letters in any order: the
changed, added or dropped letters between two multisets, a true metric that no order and
spacing of words can change and that never exceeds an edit distance of the strings. There
is a tree for each number of letters, as that bounds how many may be wrong. A value is
searched by its runs of words; by the triangle inequality a subtree is entered only where
its entries can be within that bound. What the trees return is measured by the
unrestricted Damerau-Levenshtein distance over the orders of the run's words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, keep_apart
from .canonical import form_query
from .neardup import Letters

SHARD = 50_000  # entries of one matcher; a longer list is sharded
COLUMNS = 64  # of a count of letters
RUNS = 20_000  # runs of words that are searched at once


def edit_distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance (adjacent letters may be swapped, also around later edits)."""
    far = len(a) + len(b)
    seen: dict[str, int] = {}
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, last = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), last
            cost = 1
            if x == y:
                cost, last = 0, j
            row.append(min(rows[i][j] + cost, row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        rows.append(row)
        seen[x] = i
    return rows[-1][-1]


def fewest_errors(words: list[str], entry: str, most: int) -> int:
    """The least distance of ``entry`` from the words joined in any order, or more than ``most``.

    Orders are tried word by word on one table of distances; one is given up where its
    last row has nothing below the best so far.
    """
    n, far = len(entry), len(entry) + sum(map(len, words))
    rows, seen, best = [[far] * (n + 2), [far, *range(n + 1)]], {}, most + 1

    def place(left: tuple[str, ...]) -> None:
        nonlocal best
        if not left:
            best = min(best, rows[-1][-1])
            return
        for word in dict.fromkeys(left):
            undo = []
            for x in word:
                above, i, last = rows[-1], len(rows) - 1, 0
                row = [far, i]
                for j, y in enumerate(entry, 1):
                    k, m, cost = seen.get(y, 0), last, 1
                    if x == y:
                        cost, last = 0, j
                    row.append(min(above[j] + cost, row[j] + 1, above[j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
                rows.append(row)
                undo.append((x, seen.get(x)))
                seen[x] = i
                if min(row[1:]) >= best:
                    break
            else:
                rest = list(left)
                rest.remove(word)
                place(tuple(rest))
            for x, before in reversed(undo):
                rows.pop()
                if before is None:
                    del seen[x]
                else:
                    seen[x] = before

    place(tuple(words))
    return best


class LetterCounts:
    """How often each letter occurs, in columns; letters that no entry holds share one, and rare scripts share more."""

    def __init__(self, entries: list[str]):
        letters = sorted(set("".join(entries)))
        self.column = {c: 1 + i % (COLUMNS - 1) for i, c in enumerate(letters)}

    def of(self, texts: list[str]) -> np.ndarray:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        columns = np.array([self.column.get(c, 0) for t in texts for c in t], dtype=np.int64)
        at = np.repeat(np.arange(len(texts)), sizes) * COLUMNS + columns
        return np.bincount(at, minlength=len(texts) * COLUMNS).reshape(len(texts), COLUMNS).astype(np.int16)


def letters_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Changed, added or dropped letters between multisets, row by row: the larger of what either side has alone."""
    more = a - b
    gained = np.maximum(more, 0).sum(axis=1)
    return np.maximum(gained, gained - more.sum(axis=1))


class BKTree:
    """Entries of one length and tolerance; a node's children lie at different distances from it."""

    def __init__(self, counts: np.ndarray, tolerance: int):
        """counts: of the letters of each entry. The tree is built level by level, all nodes of a level at once."""
        n = len(counts)
        self.counts, self.tolerance, self.measured = counts, tolerance, 0
        parent, edge = np.full(n, -1), np.zeros(n, dtype=np.int64)
        at, open_ = np.zeros(n, dtype=np.int64), np.arange(1, n)  # the node that each entry still to be placed stands at
        while len(open_):
            d = letters_apart(counts[open_], counts[at[open_]])
            key = at[open_] * (1 << 20) + d
            _, first, place = np.unique(key, return_index=True, return_inverse=True)
            node = open_[first]
            parent[node], edge[node] = at[node], d[first]
            at[open_] = node[place]
            open_ = np.delete(open_, first)
        self.order = np.argsort(parent, kind="stable")
        self.edge = edge[self.order]
        bounds = np.searchsorted(parent[self.order], np.arange(n + 1))
        self.first, self.many = bounds[:-1], np.diff(bounds)

    def within(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, entries) within the tolerance, for all rows of ``counts``, level by level."""
        q, node, found = np.arange(len(counts)), np.zeros(len(counts), dtype=np.int64), []
        while len(q):
            self.measured += len(q)
            d = letters_apart(counts[q], self.counts[node])
            near = d <= self.tolerance
            found.append((q[near], node[near]))
            many = self.many[node]
            child = np.repeat(self.first[node], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            q, d = np.repeat(q, many), np.repeat(d, many)
            ok = np.abs(d - self.edge[child]) <= self.tolerance
            q, node = q[ok], self.order[child[ok]]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Matcher:
    """The longest entry that fits in a value, by ``share`` of the entry's letters wrong at most."""

    def __init__(self, entries: list[tuple[int, str]], share: float = 0.2):
        """entries: (id, matching form); those without letters are left out."""
        self.known: dict[str, list[int]] = {}
        told = sorted((number, label.replace(" ", "")) for number, label in entries)
        self.entries = [(letters, number) for number, letters in told if letters]
        self.counter = LetterCounts([e for e, _ in self.entries])
        self.trees, self.rows = {}, {}
        sizes = np.array([len(e) for e, _ in self.entries], dtype=np.int64)
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            self.rows[size] = rows
            self.trees[size] = BKTree(self.counter.of([self.entries[i][0] for i in rows]), int(size * share + 1e-9))
        self.longest = max((size + tree.tolerance for size, tree in self.trees.items()), default=0)

    def runs(self, form: str) -> list[str]:
        """The runs of a value's words that are no longer than an entry may be, each with its words in order of letters."""
        words, out = form.split(), {}
        for i in range(len(words)):
            length = 0
            for j in range(i, len(words)):
                length += len(words[j])
                if length > self.longest:
                    break
                out[" ".join(sorted(words[i : j + 1]))] = None
        return list(out)

    def _search(self, runs: list[str]) -> None:
        """Note the entries whose letters are near those of each run."""
        new = [r for r in dict.fromkeys(runs) if r not in self.known]
        for start in range(0, len(new), RUNS):
            part = new[start : start + RUNS]
            joined = [r.replace(" ", "") for r in part]
            sizes, counts = np.array([len(j) for j in joined]), self.counter.of(joined)
            near: list[list[int]] = [[] for _ in part]
            for size, tree in self.trees.items():
                asked = np.flatnonzero(np.abs(sizes - size) <= tree.tolerance)
                if len(asked):
                    q, node = tree.within(counts[asked])
                    for run, entry in zip(asked[q].tolist(), self.rows[size][node].tolist()):
                        near[run].append(entry)
            self.known.update(zip(part, near))

    def best(self, forms: list[str]) -> list[tuple[int, int, int] | None]:
        """(letters of the entry, wrong letters, id) of each value: longest first, then fewest errors, then smallest id."""
        if len(self.known) > 500_000:
            self.known.clear()
        runs = [self.runs(f) for f in forms]
        self._search([r for of_one in runs for r in of_one])
        out = []
        for of_one in runs:
            met = sorted((-len(self.entries[e][0]), r, e) for r in of_one for e in self.known[r])
            best = None
            for size, run, e in met:
                if best and size > best[0]:
                    break  # only shorter entries are left
                entry, number = self.entries[e]
                most = self.trees[-size].tolerance if best is None else best[1]
                wrong = fewest_errors(run.split(), entry, most)
                if wrong <= most and (best is None or (size, wrong, number) < best):
                    best = (size, wrong, number)
            out.append(best and (-best[0], best[1], best[2]))
        return out


class AnyLetters(Letters):
    """The matching form for every script: letters and numbers without marks and case; Arabic ones as SURVEY N1 folds them."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if not 0x622 <= code <= 0x64A:
            base = unicodedata.normalize("NFKD", c).casefold()
            kept = "".join(x for x in base if unicodedata.category(x)[0] in "LN")
            c = kept or (None if unicodedata.category(c)[0] == "M" else " ")
        self[code] = c
        return c


SCRIPTS = {"arabic": Letters, "any": AnyLetters}


def matching_forms(values: DataFrame, script: str = "arabic") -> DataFrame:
    """(rec, form): the values (rec, x) in the problem-3 form, then as letters of the script parted by one space."""
    query = f"SELECT f FROM ({form_query('batch', 'x')})"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con, letters = duckdb.connect(config={"threads": 1}), SCRIPTS[script]()
        for b in batches:
            coded = b.column("x").cast(pa.string()).dictionary_encode()
            con.register("batch", pa.table({"x": coded.dictionary}))
            forms = con.sql(query).to_arrow_table().column("f").to_pylist()
            con.unregister("batch")
            folded = pa.array([" ".join(f.replace("وٰ", "ا").translate(letters).split()) for f in forms], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("rec"), folded.take(coded.indices)], names=["rec", "form"])

    return values.mapInArrow(run, "rec long, form string")


def _answers(texts: list[str], matcher: Matcher) -> pa.RecordBatch:
    best = [x or (None, None, None) for x in matcher.best(texts)]
    cols = [pa.array(texts, pa.string())] + [pa.array([x[k] for x in best], pa.int64()) for k in range(3)]
    return pa.RecordBatch.from_arrays(cols, names=["form", "size", "wrong", "id"])


def map_values(
    values: DataFrame, reference: DataFrame, rec_id: str = "rec_id", value: str = "value",
    entry_id: str = "grade_id", label: str = "label", share: float = 0.2, script: str = "arabic", shard_rows: int = SHARD,
) -> DataFrame:
    """(rec_id, grade_id) of every value that is not null, not only white space and not exactly a label.

    The id is that of the longest entry that fits a run of the value's words, in any order
    and spacing, with at most ``share`` of the entry's letters wrong; -1 where none fits.
    Ties go to fewer errors, then to the smaller id. Null labels, and labels without a letter
    of the ``script`` (``arabic``, or ``any``), are never met; with an empty list every value
    is unmatched. Repeated rows are answered one by one. The search runs once for each
    distinct form. Up to ``shard_rows`` entries go to every task; a longer list is sharded,
    each shard answers all forms, and the shards' winners merge.
    """
    listed = reference.select(F.col(entry_id).cast("long").alias("id"), F.col(label).alias("label")).where("label IS NOT NULL")
    slim = values.select(F.col(rec_id).cast("long").alias("rec"), F.col(value).alias("x"))
    slim = slim.where(F.col("x").isNotNull() & ~F.col("x").rlike(r"(?U)^[\s\x{1c}-\x{1f}]*$"))
    slim = slim.join(listed.select(F.col("label").alias("x")).distinct(), "x", "left_anti")
    rows = cut(matching_forms(slim.select("rec", "x"), script))
    forms = keep_apart(rows.select("form").distinct(), "form")
    entries = cut(matching_forms(listed.select(F.col("id").alias("rec"), F.col("label").alias("x")), script))
    shards = max(1, -(-entries.count() // shard_rows))
    schema = "form string, size long, wrong long, id long"
    if shards == 1:
        held = [(r.rec, r.form) for r in entries.collect()]  # shard_rows at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held, share)
            for b in batches:
                yield _answers(b.column("form").to_pylist(), matcher)

        found = forms.mapInArrow(run, schema).where("id IS NOT NULL")
    else:
        # every shard's entries come first, then all forms
        every = F.explode(F.sequence(F.lit(0), F.lit(int(shards) - 1)))
        stored = entries.select(F.pmod(F.xxhash64("rec", "form"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("role"), "rec", "form")
        asked = forms.select(every.alias("shard"), F.lit(1).alias("role"), F.lit(0).cast("long").alias("rec"), "form")

        def run_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, held, matcher = None, [], None
            for b in batches:
                keys, roles = b.column("shard").to_numpy(), b.column("role").to_numpy()
                edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1])]) if len(keys) else []
                for s, e in zip(edges, [*edges[1:], len(keys)]):
                    part = b.slice(s, e - s)
                    if keys[s] != number:
                        number, held, matcher = keys[s], [], None
                    texts = part.column("form").to_pylist()
                    if roles[s] == 0:
                        held += zip(part.column("rec").to_pylist(), texts)
                    else:
                        matcher = matcher or Matcher(held, share)
                        yield _answers(texts, matcher)

        placed = stored.unionByName(asked).repartitionById(int(shards), F.col("shard")).sortWithinPartitions("shard", "role")
        found = placed.mapInArrow(run_shards, schema).where("id IS NOT NULL")
        found = found.groupBy("form").agg(F.min_by("id", F.struct(-F.col("size"), "wrong", "id")).alias("id"))
    answered = rows.join(found.select("form", "id"), "form", "left")
    return answered.select(F.col("rec").alias("rec_id"), F.coalesce("id", F.lit(-1)).cast("long").alias("grade_id"))
