"""Spelling variants: words that differ by one inserted, deleted or replaced letter, and the form most used of each.

Of a pair that differs by one error either the first or the second half of the shorter word is matched exactly. So each
word goes to the groups of its halves (for its own length and for one letter less). A task reads whole groups and
builds minimal acyclic automata of their words, forward and backward: a word walks its exact half, is completed with one
error, and the word found is known by its number in the automaton (how many words come before it). A pair is taken
in one group only, told from the length of its common beginning, so nothing has to be made distinct afterwards.

A half that very many words share is split again: the exact part grows by half of what is open, at either end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, partitions, written

#: Words are so many letters long and occur so often, at least.
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A form occurs at least so many times as often as the word.
TIMES = 2
#: A group of more words is split; automata are built of about so many words.
GROUP_WORDS = 20_000
#: Keys of groups to be split are sent to all tasks up to so many, joined beyond.
MOST_SENT = 10_000
LETTERS = "([A-Za-zÀ-ÿ]+)"


def occurrences(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (``key``, word), one for each run of Latin letters of each text; A-Z in lower case. Null texts have none."""
    return docs.select(F.col(key).alias(key), F.explode(F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(LETTERS), F.lit(1))).alias("word"))


def vocabulary(words: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """Rows (word, n) of the distinct words of at least so many letters and occurrences, counted before they are shuffled."""
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words. ``go[state][letter]`` is the next state and how many words of the state come before."""

    def __init__(self, words: list[str]):
        self.go: list[dict[str, tuple[int, int]]] = [{}]
        self.final, self.size = [False], [0]
        known: dict[tuple, int] = {}
        path, previous = [0], ""
        for word in [*words, ""]:
            shared, most = 0, min(len(word), len(previous))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            for i in range(len(previous), shared, -1):  # these states get no more words: one of each kind stays
                child = self._closed(path.pop(), known)
                self.go[path[-1]][previous[i - 1]] = (child, 0)
            for letter in word[shared:]:
                self.go.append({})
                self.final.append(False)
                self.size.append(0)
                path.append(len(self.go) - 1)
                self.go[path[-2]][letter] = (path[-1], 0)
            if word:
                self.final[path[-1]] = True
            previous = word
        self._closed(0, known)

    def _closed(self, state: int, known: dict[tuple, int]) -> int:
        edges = self.go[state]
        kind = (self.final[state], *((letter, to) for letter, (to, _) in edges.items()))
        same = known.setdefault(kind, state)
        if same == state:
            before = int(self.final[state])
            for letter, (to, _) in edges.items():
                edges[letter] = (to, before)
                before += self.size[to]
            self.size[state] = before
        elif state == len(self.go) - 1:  # the last state made
            self.go.pop(), self.final.pop(), self.size.pop()
        return same

    def one_error(self, word: str, exact: int) -> list[int]:
        """Numbers of the words with one letter replaced in ``word``, or one more, behind its first ``exact`` letters; each once."""
        go, final, found, n = self.go, self.final, [], len(word)
        state = number = 0
        for i in range(n + 1):
            edges, own = go[state], word[i] if i < n else None
            if i >= exact:
                for letter, (to, before) in edges.items():
                    if letter == own:  # one more of this letter is found behind it
                        continue
                    for rest in (i + 1, i) if i < n else (n,):
                        at, place = to, number + before
                        for k in range(rest, n):
                            step = go[at].get(word[k])
                            if step is None:
                                break
                            at = step[0]
                            place += step[1]
                        else:
                            if final[at]:
                                found.append(place)
            step = edges.get(own)
            if step is None:
                break
            state = step[0]
            number += step[1]
        return found


_KEY = ["letters", "forward", "head", "tail", "part"]


def _placed(rows: DataFrame) -> DataFrame:
    """With the exact part: the first ``head`` letters of the word, and the last ``tail``."""
    return rows.withColumn("part", F.expr("concat(substring(word, 1, head), ' ', substring(word, length(word) - tail + 1, tail))"))


def _groups(words: DataFrame, least_letters: int) -> DataFrame:
    """Rows (``_KEY``, word, n): each word in the groups of its halves, as a word of ``letters`` letters or of one more."""
    sized = words.select("word", "n", F.explode(F.expr("array(length(word), length(word) - 1)")).alias("letters")).where(F.col("letters") >= least_letters)
    half = F.expr("letters div 2").cast("int")
    ways = F.array(F.struct(F.lit(True).alias("forward"), half.alias("head"), F.lit(0).alias("tail")), F.struct(F.lit(False).alias("forward"), F.lit(0).alias("head"), (F.col("letters") - half).alias("tail")))
    return _placed(sized.select("word", "n", "letters", F.explode(ways).alias("w")).select("word", "n", "letters", "w.*"))


def _split(rows: DataFrame, group_words: int) -> DataFrame:
    """The rows where groups of more than ``group_words`` are split until they have fewer, or one letter is open."""
    done = None
    while True:
        sizes = rows.groupBy(_KEY).agg(F.count("*").alias("_n")).where((F.col("_n") > group_words) & (F.col("letters") - F.col("head") - F.col("tail") > 1))
        large = written(sizes.select(_KEY), "large_groups")
        n = large.count()
        if n == 0:
            return rows if done is None else done.unionByName(rows)
        large = F.broadcast(large) if n <= MOST_SENT else large
        small = rows.join(large, _KEY, "left_anti")
        done = small if done is None else done.unionByName(small)
        step = F.expr("(letters - head - tail) div 2").cast("int")
        ways = F.array(F.struct((F.col("head") + step).alias("head"), F.col("tail")), F.struct(F.col("head"), (F.col("letters") - F.col("head") - step).alias("tail")))
        rows = written(_placed(rows.join(large, _KEY).select("word", "n", "letters", "forward", F.explode(ways).alias("w")).select("word", "n", "letters", "forward", "w.*")), "split_groups")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads whole groups, sorted by their keys: the near pairs (a, b) with their counts."""
    held: list[tuple[tuple, list[str], list[int]]] = []
    size = 0

    def search() -> pa.RecordBatch:
        a: list[str] = []
        b: list[str] = []
        count: list[tuple[int, int]] = []
        for forward in (True, False):
            groups = [g for g in held if g[0][1] == forward]
            counts = {w if forward else w[::-1]: n for _, words, ns in groups for w, n in zip(words, ns)}
            ordered = sorted(counts)
            automaton = Automaton(ordered)
            for (letters, _, head, tail, _), words, ns in groups:
                stop = letters - tail if tail else letters + 1
                for word, n in zip(words, ns):
                    if len(word) != letters:
                        continue
                    for number in automaton.one_error(word if forward else word[::-1], head if forward else tail):
                        found = ordered[number]
                        other = found if forward else found[::-1]
                        if len(other) == letters and other < word:
                            continue  # found from the other word
                        shared = head
                        while shared < letters and word[shared] == other[shared]:
                            shared += 1
                        if shared < stop and word[:head] == other[:head]:
                            a.append(word)
                            b.append(other)
                            count.append((n, counts[found]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array([x for x, _ in count], pa.int64()), pa.array(b, pa.string()), pa.array([x for _, x in count], pa.int64())], names=["a", "n_a", "b", "n_b"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for *key, word, n in zip(*columns):
            if not held or held[-1][0] != tuple(key):
                if size >= GROUP_WORDS:
                    yield search()
                    held, size = [], 0
                held.append((tuple(key), [], []))
            held[-1][1].append(word)
            held[-1][2].append(n)
            size += 1
    if held:
        yield search()


def near_pairs(words: DataFrame, least_letters: int = LEAST_LETTERS, group_words: int = GROUP_WORDS) -> DataFrame:
    """Rows (a, n_a, b, n_b): each pair of ``words`` (word, n; distinct, of ``least_letters`` or more) one error apart, once."""
    rows = _split(_groups(words, least_letters), group_words)
    dealt = rows.select(*_KEY, "word", "n").repartition(partitions(words.sparkSession), *_KEY).sortWithinPartitions(*_KEY)
    return dealt.mapInArrow(_pairs, "a string, n_a long, b string, n_b long")


def variants(words: DataFrame, least_letters: int = LEAST_LETTERS, times: int = TIMES, group_words: int = GROUP_WORDS) -> DataFrame:
    """One row (word, form, root, n, n_near, form_n) per row of ``words`` (word, n): distinct words of ``least_letters`` or more, with their counts.

    ``n_near`` counts the words one error apart. ``form`` is the near word of the largest count (of equal ones the first in
    code-point order) if that is ``times`` (two or more) the word's own or more, else null. ``root`` follows the forms to the
    last one; as counts double at least, no chain has more than 63. An empty table has no rows; null words are left out.
    """
    if times < 2:
        raise ValueError("counts must double along forms, or chains need not end")
    words = written(words.where("word is not null").select("word", "n"), "vocabulary")
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))))
    near = near_pairs(words, least_letters, group_words).select(both.alias("p")).select("p.*")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("first"))
    formed = words.join(best, "word", "left").withColumn("_is", -F.col("first.less") >= F.col("n") * times)
    formed = formed.select("word", F.when(F.col("_is"), F.col("first.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_is"), -F.col("first.less")).alias("form_n"))
    formed = written(formed, "forms")
    # Each round a root's root takes its place: chains of 63 end after six.
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = written(roots.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        moved = roots.where("_moved").limit(1).count()
        roots = roots.drop("_moved")
        if not moved:
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
