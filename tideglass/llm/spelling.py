"""Spelling variants: words one edit apart, by Aho-Corasick automata over the halves of words.

Two words differ by exactly one inserted, deleted or replaced code point. The edit falls into one half of the shorter
word (of either, if they are equally long), so the other half stands unchanged in the longer one: the first half at its
start, the second half at its end. Automata hold both halves of every word and scan all words; a hit counts if the half
stands where it must and lengths fit, and what remains beside it is then verified to differ by one edit.

Halves are sharded by their side, the length of their word and their first (last) code points, at most four; a word can
only meet the shards of its own ends and of its own length or one less, so it is scanned by four shards however many
there are. A shard of more than SHARD halves is dealt into several, which all scan its words. Within a shard the rests
of words beside an equal half are looked up with one place left out, so a half that many words share does not compare
them with each other; each pair is found once. A word has no more neighbours than its length and the alphabet allow
(at most 59 * (2 * length + 1)), so pairs grow with the words.

Null texts have no words; a null doc_id counts as an empty one. Repeated rows are counted each. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.cuts import pieces, words
from tideglass.llm.store import materialize, release, width

LETTERS = "A-Za-zÀ-ÿ"
#: Halves that one automaton holds.
SHARD = 50_000
#: Code points of a half that name its shard.
ENDS = 4


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", drop: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """word, n: lower-cased (A-Z) runs of letters of at least `shortest` code points, at least `least` times over all
    texts. Where `drop` divides the crc32 of `<key>:<run>`, the run loses one code point first (0: never)."""
    # Runs only get shorter, so shorter ones matter nothing; a run of letters is taken whole or not at all.
    found = pieces(docs, key, text, f"[{LETTERS}]+").select("key", F.explode(words("text", f"[{LETTERS}]{{{shortest},}}")).alias("run"))
    if drop:
        h = F.crc32(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
        at = (F.pmod(F.col("h"), F.length("run")) + 1).cast("int")
        cut = F.concat(F.col("run").substr(F.lit(1), at - 1), F.col("run").substr(at + 1, F.length("run")))
        found = found.withColumn("h", h).select(F.when(F.col("h") % drop == 0, cut).otherwise(F.col("run")).alias("word"))
        found = found.where(F.length("word") >= shortest)
    else:
        found = found.select(F.col("run").alias("word"))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class Shard:
    """Halves of words in an automaton. A half is held with its side and the length of its words; rests of words beside
    it are held with one place left out (for a replacement) and whole (for an insertion)."""

    def __init__(self):
        self.halves: dict[str, list[tuple[int, int]]] = {}
        self.rests: dict[tuple, list[str]] = {}
        self.automaton = None

    def hold(self, word: str, side: int) -> None:
        n = len(word)
        half, rest = (word[: n // 2], word[n // 2 :]) if side == 0 else (word[n // 2 :], word[: n // 2])
        if (side, n) not in self.halves.setdefault(half, []):
            self.halves[half].append((side, n))
        for i in range(len(rest)):
            self.rests.setdefault((half, side, n, i, rest[:i] + rest[i + 1 :]), []).append(word)
        self.rests.setdefault((half, side, n, rest), []).append(word)

    def scan(self, word: str, sides: set[int]) -> Iterator[tuple[str, str]]:
        """Pairs (held word, this word): held words as long that are smaller, and held words one shorter."""
        import ahocorasick

        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for half in self.halves:
                self.automaton.add_word(half, half)
            self.automaton.make_automaton()
        size = len(word)
        for end, half in self.automaton.iter(word):
            for side, n in self.halves[half]:
                # Offset and length: a first half begins the word, a second half ends it.
                if side not in sides or not 0 <= size - n <= 1 or (end + 1 != len(half) if side == 0 else end + 1 != size):
                    continue
                rest = word[len(half) :] if side == 0 else word[: size - len(half)]
                if n == size:
                    for i in range(len(rest)):
                        for held in self.rests.get((half, side, n, i, rest[:i] + rest[i + 1 :]), ()):
                            if held < word and one_edit(held, word):
                                yield held, word
                    continue
                seen: set[str] = set()
                for i in range(len(rest)):
                    for held in self.rests.get((half, side, n, rest[:i] + rest[i + 1 :]), ()):
                        # Where both halves stand unchanged, the first one tells of it.
                        if held not in seen and one_edit(held, word) and not (side == 1 and word.startswith(held[: n // 2])):
                            seen.add(held)
                            yield held, word


def near_pairs(vocab: DataFrame, shard: int = SHARD) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of words of vocab (word, n; written) that differ by one edit, each once."""
    spark = vocab.sparkSession
    w, n = F.col("word"), F.length("word")
    half = (n / 2).cast("int")

    def names(length: Column, side: int) -> Column:
        """The shard of a half by its side, its word's length, and the end of it that a longer word shares."""
        held = (length / 2).cast("int") if side == 0 else length - (length / 2).cast("int")
        reach = F.least(held, F.lit(ENDS))
        end = w.substr(F.lit(1), reach) if side == 0 else w.substr(n - reach + 1, reach)
        return F.xxhash64(F.lit(side), length, end)

    # Halves (role 0) come before the words that scan them.
    halves = (w.substr(F.lit(1), half), w.substr(half + 1, n))
    held = [vocab.select(names(n, s).alias("name"), F.lit(s).alias("side"), w, "n", halves[s].alias("half")) for s in (0, 1)]
    held = held[0].unionByName(held[1])
    asks = [vocab.select(names(n - less, s).alias("name"), F.lit(s).alias("side"), w, "n") for s in (0, 1) for less in (0, 1)]
    asks = asks[0].unionByName(asks[1]).unionByName(asks[2]).unionByName(asks[3])
    # Names with more halves than an automaton holds; fewer than halves / shard rows.
    large = materialize(held.groupBy("name").count().where(F.col("count") > shard).select("name", F.ceil(F.col("count") / shard).cast("int").alias("cuts")), "spelling-large")
    cuts = F.coalesce("cuts", F.lit(1))
    held = held.join(F.broadcast(large), "name", "left").withColumn("cut", F.pmod(F.xxhash64("half"), cuts).cast("int"))
    asks = asks.join(F.broadcast(large), "name", "left").withColumn("cut", F.explode(F.sequence(F.lit(0), cuts - 1)))
    # Names share automata: about `shard` halves to each, and at least as many of them as tasks.
    total = 2 * vocab.count()
    pots = max(width(spark), -(-total // shard))
    pot = F.pmod(F.xxhash64("name", "cut"), F.lit(pots)).cast("int").alias("pot")
    both = held.select(pot, F.lit(0).alias("role"), "side", "word", "n").unionByName(asks.select(pot, F.lit(1).alias("role"), "side", "word", "n"))
    one = both.repartition(width(spark), "pot").groupBy("pot", "role", "word")
    met = one.agg(F.max("n").alias("n"), F.max(F.col("side") == 0).alias("first"), F.max(F.col("side") == 1).alias("second")).sortWithinPartitions("pot", "role", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pot, shard, counts, out = None, Shard(), {}, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 4
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["a", "b", "n_a", "n_b"])

        for batch in batches:
            for p, role, word, n, first, second in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != pot:
                    pot, shard, counts = p, Shard(), {}
                sides = {s for s, on in ((0, first), (1, second)) if on}
                if role == 0:
                    counts[word] = n
                    for s in sides:
                        shard.hold(word, s)
                elif shard.halves:
                    out += [(a, b, counts[a], n) for a, b in shard.scan(word, sides)]
            if len(out) > 50_000:
                yield flush()
                out = []
        yield flush()

    return met.mapInArrow(run, "a string, b string, n_a bigint, n_b bigint")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for each row of forms (word, form or null; written): the last word that forms lead to. Forms are at
    least twice as frequent as their words, so steps that double end after six rounds at most."""
    now = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        now = materialize(now, "spelling-roots")
        onward = now.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(onward, "root", "left")
        if step.where("next IS NOT NULL").isEmpty():
            return now
        now = step.select("word", F.coalesce("next", "root").alias("root"))


def variants(vocab: DataFrame, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for vocab (word, n). The form of a word is the most frequent of its near
    words (ties: smallest in code-point order) if that is at least `factor` times as frequent as the word."""
    vocab = materialize(vocab, "spelling-words")
    pairs = materialize(near_pairs(vocab), "spelling-pairs")
    seen = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m"))
    seen = seen.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    best = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("near").alias("near"))).alias("best"))
    near = vocab.join(best, "word", "left")
    takes = -F.col("best.less") >= factor * F.col("n")
    forms = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")), "spelling-forms")
    release(pairs)
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")
