"""Spelling variants by finite-state composition: vocabulary, one edit, vocabulary again.

The vocabulary is an acceptor. Composed with a transducer that makes one edit and with the
acceptor once more, it accepts the pairs of words that are one insertion, deletion or
replacement of a code point apart. The transducer edits where the two words first differ, so
every pair has one path and comes out once.

The start state is partitioned into cells, and each pair belongs to one of them. A cell
(m, a, b, left, right) has the pairs whose shorter word has m letters and whose first difference
is at a place p with a <= p < b; such words agree before a and behind b, and so both stand in
it. Each word starts in four cells, two for each length that its partner may have as the
shorter one. A cell of more than ``CELL`` words is cut into two narrower ones until none is
left or the place is a single one, where a cell is bounded by the letters of the script. So no
group of similar words, however large, is gathered in a task.

A task gets the cells of one bucket and builds one minimised acceptor for all of them: each cell
has two start states, for the middles of its shorter and of its longer words, and equal
suffixes share their states. Compositions are searched from these start states; pairs of
states that accept nothing in common are known once and left out. Buckets are as many as the
vocabulary needs.

Words are counted with combination before the shuffle, so a frequent word is sent once
by a task. Roots are found by doubling: the steps are logarithmic in the longest chain of forms,
which is short because a form is several times as frequent as its word.

Defined cases: a null or empty text has no words; repeated rows count again; a null id is
the empty text where ids matter; letters are code points; ties of frequency go to the
smallest word in code-point order; an empty table gives an empty table; a null word is
left out; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import text_of
from quirefold.session import cut_lineage, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"a-zÀ-ÿ"
RATIO = 5
CELL = 10_000
BUCKET_ROWS = 20_000
MAX_ROUNDS = 64


def dropped_letter(doc_id: Column, run: Column, every: int) -> Column:
    """The run without its letter h % length, where h is the crc32 of ``<doc_id>:<run>`` and ``every`` divides h."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def count_words(
    df: DataFrame, least_letters: int = 6, least_count: int = 5, key: str = "doc_id", text: str = "text", drop_every: int | None = None
) -> DataFrame:
    """Columns ``word``, ``n``: words (runs of Latin letters, A-Z in lower case) of enough letters and occurrences.

    ``drop_every`` takes a letter from one in so many pairs of document and run (``dropped_letter``).
    """
    # Runs that are too short cannot grow, so they are not taken apart from the text.
    runs = F.regexp_extract_all(F.translate(text_of(text), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))
    found = df.select(F.col(key).alias("id"), F.explode(runs).alias("run"))
    word = F.col("run") if drop_every is None else dropped_letter(F.col("id"), F.col("run"), drop_every)
    words = found.select(word.alias("word")).where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


class Acceptor:
    """A minimal acceptor with several start states; all words of a start state have one length.

    A state is its transitions by letter; equal states are one. State 0 is the end.
    """

    def __init__(self):
        self.states: list[dict[str, int]] = [{}]
        self._known = {(): 0}
        self._meets: dict[tuple[int, int], bool] = {}
        self._swaps: dict[int, list[tuple[str, str, int, int]]] = {}

    def _state(self, moves: dict[str, int]) -> int:
        sign = tuple(moves.items())
        if sign not in self._known:
            self._known[sign] = len(self.states)
            self.states.append(moves)
        return self._known[sign]

    def start(self, words: list[str]) -> int | None:
        """The start state of sorted distinct words of one length; None without words."""
        if not words:
            return None
        path: list[dict[str, int]] = [{}]
        before = ""
        for word in words:
            same = 0
            while same < len(before) and before[same] == word[same]:
                same += 1
            while len(path) > same + 1:
                made = self._state(path.pop())
                path[-1][before[len(path) - 1]] = made
            path.extend({} for _ in word[same:])
            before = word
        while len(path) > 1:
            made = self._state(path.pop())
            path[-1][before[len(path) - 1]] = made
        return self._state(path[0])

    def meets(self, left: int, right: int) -> bool:
        """Whether two states accept a word in common. Explicit stack: words may be long."""
        known, stack = self._meets, [(left, right)]
        while stack:
            pair = stack[-1]
            x, y = pair
            if x == y:
                known[pair] = True
            if pair in known:
                stack.pop()
                continue
            a, b = self.states[x], self.states[y]
            next_pairs = [(to, b[letter]) for letter, to in a.items() if letter in b]
            if any(p == q or known.get((p, q)) for p, q in next_pairs):
                known[pair] = True
            else:
                open_ = next((p for p in next_pairs if p not in known), None)
                if open_ is None:
                    known[pair] = False
                else:
                    stack.append(open_)
        return known[left, right]

    def common(self, left: int, right: int) -> Iterator[str]:
        """The words that both states accept."""
        stack = [(left, right, "")]
        while stack:
            x, y, said = stack.pop()
            if x == 0:
                yield said
                continue
            a, b = self.states[x], self.states[y]
            stack.extend((to, b[c], said + c) for c, to in a.items() if c in b and (to == b[c] or self.meets(to, b[c])))

    def replaced(self, start: int) -> Iterator[tuple[str, str]]:
        """Pairs of words of a start state that differ in one letter, the smaller one first."""
        stack = [(start, "")]
        while stack:
            state, said = stack.pop()
            moves = self.states[state]
            swaps = self._swaps.get(state)
            if swaps is None:
                letters = list(moves)
                pairs = ((a, b) for i, a in enumerate(letters) for b in letters[i + 1 :])
                swaps = self._swaps[state] = [(a, b, moves[a], moves[b]) for a, b in pairs if self.meets(moves[a], moves[b])]
            for a, b, x, y in swaps:
                for rest in self.common(x, y):
                    yield said + a + rest, said + b + rest
            stack.extend((to, said + c) for c, to in moves.items())

    def inserted(self, shorter: int, longer: int, at_end: bool) -> Iterator[tuple[str, str]]:
        """Pairs of a word and the same word with a letter put in before its end, or there too where ``at_end``."""
        stack = [(shorter, longer, "")]
        while stack:
            x, y, said = stack.pop()
            a, b = self.states[x], self.states[y]
            if x == 0:
                if at_end:
                    yield from ((said, said + c) for c in b)
                continue
            for put, to in b.items():
                behind = self.states[to]
                for c, rest in a.items():
                    if c != put and c in behind and self.meets(rest, behind[c]):
                        yield from ((said + c + t, said + put + c + t) for t in self.common(rest, behind[c]))
            stack.extend((to, b[c], said + c) for c, to in a.items() if c in b)


def compose(rows: Iterator[tuple[str, int, int, int]]) -> Iterator[tuple[str, str]]:
    """Near pairs of a bucket's rows (word, m, a, b), each once for every cell that has it."""
    cells = defaultdict(lambda: (set(), set()))
    for word, m, a, b in rows:
        more = len(word) - m
        cells[m, a, b, word[:a], word[b + more :]][more].add(word[a : b + more])
    acceptor = Acceptor()
    starts = [(cell, acceptor.start(sorted(s)), acceptor.start(sorted(t))) for cell, (s, t) in cells.items()]
    for (m, _, b, left, right), shorter, longer in starts:
        if shorter is None:
            continue
        for x, y in acceptor.replaced(shorter):
            yield left + x + right, left + y + right
        if longer is not None:
            for x, y in acceptor.inserted(shorter, longer, b > m):
                yield left + x + right, left + y + right


def _cells(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, a, b) with the hash of their cell, in cells that may have a pair."""
    more = F.length("word") - F.col("m")
    left, right = F.substr("word", F.lit(1), F.col("a")), F.substr(F.col("word"), F.col("b") + more + 1)
    named = rows.withColumn("cell", F.xxhash64("m", "a", "b", left, right))
    sizes = named.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_cell"), F.count(F.when(F.length("word") == F.col("m"), 1)).alias("n_shorter")
    )
    return named.join(sizes.where((F.col("n_cell") > 1) & (F.col("n_shorter") > 0)).select("cell", "n_cell"), "cell")


def _cut(rows: DataFrame) -> DataFrame:
    """The rows once for each half of their places [a, b)."""
    middle = F.expr("(a + b) div 2").cast("int")
    halves = F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))
    return rows.select("word", "n", "m", F.explode(halves).alias("h")).select("word", "n", "m", "h.a", "h.b")


def cell_tables(vocabulary: DataFrame, cell: int = CELL) -> list[DataFrame]:
    """Written tables of words with their cells; of each table the cells that need no further cut count (``_whole``)."""
    length = F.length("word")
    shorter = F.explode(F.filter(F.array(length, length - 1), lambda m: m > 0)).alias("m")
    whole = vocabulary.where(F.col("word").isNotNull()).select("word", "n", shorter)
    rows, tables = _cut(whole.withColumn("a", F.lit(0)).withColumn("b", F.col("m") + 1)), []
    while True:
        tables.append(cut_lineage(_cells(rows)))
        large = tables[-1].where(~_whole(cell))
        if large.isEmpty():
            return tables
        rows = _cut(large)


def _whole(cell: int) -> Column:
    return (F.col("n_cell") <= cell) | (F.col("b") - F.col("a") == 1)


def near_words(tables: list[DataFrame], cell: int = CELL, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Columns ``word``, ``near``, ``near_n``: both directions of each pair of words one edit apart.

    ``tables`` are ``cell_tables`` of distinct words in ``word`` with their frequency in ``n``.
    """
    held = tables[0].where(_whole(cell))
    for part in tables[1:]:
        held = held.unionByName(part.where(_whole(cell)))
    buckets = max(1, -(-held.count() // bucket_rows))

    def search(group: pa.Table) -> pa.Table:
        words, counts = group["word"].to_pylist(), group["n"].to_pylist()
        n_of = dict(zip(words, counts))
        pairs = list(compose(zip(words, *(group[c].to_pylist() for c in ("m", "a", "b")))))
        left, right = [p[0] for p in pairs], [p[1] for p in pairs]
        both = (left + right, right + left)
        near_n = [n_of[w] for w in both[1]]
        return pa.table({"word": pa.array(both[0], pa.string()), "near": pa.array(both[1], pa.string()), "near_n": pa.array(near_n, pa.int64())})

    dealt = held.select("word", F.col("n").cast("bigint").alias("n"), "m", "a", "b", F.pmod("cell", F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(search, "word string, near string, near_n bigint")


def roots_of(forms: DataFrame) -> DataFrame:
    """Columns ``word``, ``root``: the last of the chain of ``form`` from each ``word``; chains have no loops."""
    current = cut_lineage(forms.select("word", F.col("form").alias("root")))
    for _ in range(MAX_ROUNDS):
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if current.join(further, "root", "left_semi").isEmpty():
            return current
        before = current
        current = cut_lineage(current.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        release(before)
    raise RuntimeError("chains of forms did not end")


def group_variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Columns ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` for every word.

    The form of a word is its most frequent near word, if that is at least ``ratio`` times as
    frequent; the root is the end of the chain of forms, the word itself without one.
    """
    vocabulary = cut_lineage(vocabulary.where(F.col("word").isNotNull()).select("word", F.col("n").cast("bigint").alias("n")))
    tables = cell_tables(vocabulary)
    best = near_words(tables).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"))).alias("best")
    )
    frequent = -F.col("best.order") >= ratio * F.col("n")
    formed = cut_lineage(
        vocabulary.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(frequent, F.col("best.near")).alias("form"),
            F.when(frequent, -F.col("best.order")).alias("form_n"),
        )
    )
    release(vocabulary, *tables)
    roots = roots_of(formed.where(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
