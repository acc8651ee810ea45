"""Spelling variants: words of a corpus that are one inserted, deleted or replaced letter apart.

The vocabulary is a minimised acceptor. Composed with a transducer that makes exactly one edit, and
with the acceptor again, it accepts the pairs of near words; walking the composition
enumerates them, and a pair of states from which nothing is accepted is left at once.

No automaton holds the whole vocabulary. The composition is cut at its initial states: before the edit both
words follow the same path, so the pairs whose edit comes after a prefix are those of the
residual acceptors behind the state that the prefix leads to. An edit before the middle of a word is found by the
mirrored cut, with the suffix behind the edit in common. A partition of the composition
is thus a window of letters with all others fixed. A window with too many words is halved, again and again;
one of a single letter has at most 90 words of one length and 8100 of the next, so every
automaton is of bounded size, whatever the vocabulary, and no pair is lost or found twice.
"""

import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentmeter.llm.common import land

LETTERS = r"[A-Za-zÀ-ÿ]+"
SPOILT_ONE_IN = 97
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
#: Words in a partition of the composition. Not less than 90 + 90 * 90: single letters aren't cut.
MOST = 8192


def vocabulary(
    documents: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, count: int = LEAST_COUNT
) -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case, of ``letters`` letters and ``count`` occurrences at least.

    One run in 97 by the CRC-32 of ``<key>:<run>`` has lost a letter. Null texts have no runs; a null key counts as
    empty there. Repeated rows count as often as they come; no rows give no words.
    """
    body = F.col(text).cast("string")
    id_text = F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id")
    runs = documents.select(id_text, F.explode(F.regexp_extract_all(body, F.lit(LETTERS), F.lit(0))).alias("run"))
    run = F.col("run")
    # Lower-casing is fast in ASCII and touches À to Þ elsewhere.
    low = F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(
        F.translate(run, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
    hashed = runs.where(F.char_length(run) >= letters).select("id", low.alias("run"))
    hashed = hashed.select("run", F.crc32(F.concat(F.col("id"), F.lit(":"), run).cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.char_length(run)).cast("int")
    less = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.char_length(run)))
    words = hashed.select(F.when(F.pmod("h", F.lit(SPOILT_ONE_IN)) == 0, less).otherwise(run).alias("word"))
    counted = words.where(F.char_length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= count)


# States and arcs of minimised acceptors. A state is (is final, arcs as (letter, state) in order).
State = tuple[bool, tuple]
DEAD: State = (False, ())


def minimised(words: Iterable[str]) -> State:
    """The initial state of the minimised acceptor of sorted, different words; equal states are one object."""
    register: dict[tuple, State] = {}

    def closed(node: list) -> State:
        kept = (node[0], tuple(node[1]))
        return register.setdefault((kept[0], tuple((c, id(s)) for c, s in kept[1])), kept)

    path, last = [[False, []]], ""
    for word in words:
        same = 0
        while same < len(last) and same < len(word) and last[same] == word[same]:
            same += 1
        while len(path) > same + 1:
            done = closed(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        path += [[False, []] for _ in word[same:]]
        path[-1][0], last = True, word
    while len(path) > 1:
        done = closed(path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    return closed(path[0])


class Composed:
    """An acceptor composed with one edit and another acceptor; what both accept behind an edit is worked out once.

    Replacements are between words of the first acceptor, insertions lead from it to the second. Where only one way
    leads on it is followed in a loop, so long words cost no depth.
    """

    def __init__(self, short: State, long: State) -> None:
        self.short, self.long = short, long
        self.behind: dict[tuple[int, int], list[str]] = {}

    def shared(self, p: State, q: State) -> list[str]:
        """The strings that both states accept: the composition behind its edit."""
        passed = []
        while True:
            end, others = p[0] and q[0], dict(q[1])
            both = [(c, state, others[c]) for c, state in p[1] if c in others]
            if end or len(both) != 1:
                break
            passed.append(both[0][0])
            _, p, q = both[0]
        name = (id(p), id(q))
        found = self.behind.get(name)
        if found is None:
            found = [""] if end else []
            for c, this, that in both:
                found += [c + rest for rest in self.shared(this, that)]
            self.behind[name] = found
        if not passed:
            return found
        start = "".join(passed)
        return [start + rest for rest in found]

    def replaced(self) -> Iterator[tuple[str, str]]:
        """Pairs of words of the first acceptor that differ in one letter, the smaller first."""
        stack = [("", self.short)]
        while stack:
            said, (_, arcs) = stack.pop()
            passed = [said]
            while len(arcs) == 1:
                passed.append(arcs[0][0])
                arcs = arcs[0][1][1]
            said = "".join(passed)
            for i, (a, p) in enumerate(arcs):
                stack.append((said + a, p))
                for b, q in arcs[i + 1 :]:
                    for rest in self.shared(p, q):
                        yield said + a + rest, said + b + rest

    def inserted(self, at_end: bool) -> Iterator[tuple[str, str]]:
        """Pairs of a word and one that has one letter more.

        Of the places where the letter may have come in, the last counts, where the letter behind it differs; the end
        of the words counts only if ``at_end``.
        """
        stack = [(self.short, self.long, [""])]
        while stack:
            p, q, passed = stack.pop()
            while True:
                own = dict(p[1])
                for b, state in q[1]:
                    rests = [""] if at_end and p[0] and state[0] else []
                    for c, beyond in state[1]:
                        if c != b and c in own:
                            rests += [c + rest for rest in self.shared(own[c], beyond)]
                    if rests:
                        said = "".join(passed)
                        for rest in rests:
                            yield said + rest, said + b + rest
                both = [(b, own[b], state) for b, state in q[1] if b in own]
                if len(both) != 1:
                    break
                letter, p, q = both[0]
                passed.append(letter)
            if both:
                said = "".join(passed)
                stack += [(this, that, [said, b]) for b, this, that in both]


def near_pairs(short: list[str], long: list[str], at_end: bool) -> Iterator[tuple[str, str]]:
    """All pairs within a partition, each once; ``short`` of one length and ``long`` of the next, sorted."""
    composed = Composed(minimised(short), minimised(long) if long else DEAD)
    yield from composed.replaced()
    yield from composed.inserted(at_end)


def _window(rows: DataFrame) -> DataFrame:
    """The partition that each row belongs to, as one hash; where two share a hash the words tell them apart."""
    fixed = F.concat(F.substring("word", F.lit(1), F.col("lo")), F.lit("\n"), F.col("word").substr(F.char_length("word") - F.col("behind") + 1, F.char_length("word")))
    return rows.withColumn("part", F.xxhash64("base", "lo", "behind", fixed))


def _halved(rows: DataFrame) -> DataFrame:
    """Every window as its two halves."""
    middle = F.col("lo") + F.expr("(base - behind - lo) div 2")
    halves = F.array(
        F.struct(F.col("lo").alias("lo"), (F.col("base") - middle).alias("behind")),
        F.struct(middle.alias("lo"), F.col("behind").alias("behind")),
    )
    cut = rows.select("word", "n", "base", F.explode(halves).alias("w"))
    return _window(cut.select("word", "n", "base", F.col("w.lo").alias("lo"), F.col("w.behind").alias("behind")))


def _partitioned(words: DataFrame, most: int) -> DataFrame:
    """(part, word, n, base, lo, behind): every word in its partitions.

    ``base`` is the length of the shorter words there, ``lo`` and ``behind`` the letters fixed at both ends.
    A word is there once as one of the shorter words and once as one of the longer ones.
    """
    size = F.char_length("word")
    bases = F.explode(F.filter(F.array(size, size - 1), lambda base: base > 0)).alias("base")
    whole = words.select("word", "n", bases).withColumn("lo", F.lit(0)).withColumn("behind", F.lit(0))
    open_rows, cold = _halved(whole), None
    while True:
        open_rows = land(open_rows, "windows")
        wide = F.col("base") - F.col("behind") - F.col("lo") > 1
        hot = open_rows.where(wide).groupBy("part").count().where(F.col("count") > most).select("part")
        hot = land(hot, "hot")
        if not hot.limit(1).count():
            return open_rows if cold is None else cold.unionByName(open_rows)
        small = land(open_rows.join(hot, "part", "left_anti"), "cold").select(open_rows.columns)
        cold = small if cold is None else cold.unionByName(small)
        # Single letters of a hash that wider windows share stay whole.
        again = open_rows.join(hot, "part", "left_semi").select(open_rows.columns)
        cold = cold.unionByName(again.where(~wide))
        open_rows = _halved(again.where(wide))


def _enumerating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best_n, best) of each word with near words in a partition; rows come sorted by partition."""

    def searched(rows: list[tuple]) -> Iterator[tuple]:
        parts: dict[tuple, tuple[dict, dict]] = {}
        for word, n, base, lo, behind in rows:
            end = len(word) - behind
            name = (base, lo, behind, word[:lo], word[end:])
            parts.setdefault(name, ({}, {}))[len(word) > base][word[lo:end]] = n
        for (_, _, behind, head, tail), (short, long) in parts.items():
            if not short or len(short) + len(long) < 2:
                continue
            near: dict[str, list] = {}
            for a, b in near_pairs(sorted(short), sorted(long), not behind):
                longer = long if len(b) > len(a) else short
                for this, that, n in ((a, b, longer[b]), (b, a, short[a])):
                    held = near.get(this)
                    if held is None:
                        near[this] = [1, n, that]
                    else:
                        held[0] += 1
                        if n > held[1] or n == held[1] and that < held[2]:
                            held[1:] = n, that
            for word, (count, n, best) in near.items():
                yield head + word + tail, count, n, head + best + tail

    def batched(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n_near", "best_n", "best"]
        )

    # Depth grows with the places where several words part, not with their letters.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1 << 16))
    held, part, out = [], None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "word", "n", "base", "lo", "behind")]
        for name, *row in zip(*columns, strict=True):
            if name != part:
                if len(held) > 1:
                    out += searched(held)
                held, part = [], name
                if len(out) >= 1 << 13:
                    yield batched(out)
                    out = []
            held.append(row)
    if len(held) > 1:
        out += searched(held)
    if out:
        yield batched(out)


def nearest(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, best_n, best) of every word of (word, n) that has near words: how many, and the most frequent of them.

    Of equally frequent near words the smallest by code points is taken. The empty word and null take no part; words must
    not repeat. ``most`` changes how the work is cut, not what is found.
    """
    spread = _partitioned(words, most).repartition("part").sortWithinPartitions("part")
    found = spread.select("part", "word", "n", "base", "lo", "behind").mapInArrow(
        _enumerating, "word string, n_near long, best_n long, best string"
    )
    first = F.min_by("best", F.struct(-F.col("best_n"), F.col("best")))
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.max("best_n").alias("best_n"), first.alias("best")
    )


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends.

    Every round replaces what a word points to by what that points to. Forms are at least twice as frequent as their
    words, so a chain has fewer than 64 words and six rounds are enough; fewer are run where nothing moves any more.
    """
    up = land(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = land(up.join(further, "root", "left").select("word", "root", "further"), "roots")
        if not moved.where("further IS NOT NULL").limit(1).count():
            return up
        up = moved.select("word", F.coalesce("further", "root").alias("root"))


def variants(documents: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of every word of the vocabulary.

    ``form`` is the most frequent near word if it is at least twice as frequent, else null; ``root`` is where following forms
    ends. See ``vocabulary`` for nulls, repeated rows and no rows; other columns are ignored.
    """
    words = land(vocabulary(documents, key, text), "vocabulary")
    near = words.join(nearest(words, most), "word", "left")
    clear = F.col("best_n") >= RATIO * F.col("n")
    formed = land(
        near.select(
            "word",
            "n",
            F.when(clear, F.col("best")).alias("form"),
            F.when(clear, F.col("best_n")).alias("form_n"),
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        ),
        "formed",
    )
    return formed.join(rooted(formed), "word", "left").withColumn("root", F.coalesce("root", "word"))
