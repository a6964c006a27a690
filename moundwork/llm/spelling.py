"""Spelling variants: words one edit apart, found by a frontier of states over a distributed trie.

The trie is a table of edges, built level by level: all words at a node are grouped by their next
character, and a group's longest common prefix (that of its least and greatest word, which combine
before the shuffle) is the next node. Nodes are only where words part, so a path is as long as there
are partings on it, however long the words are. Edges are keyed by their ``step``: the node's prefix
and the next character, or the prefix alone where a word ends.

The frontier holds states (word, position, node, edits). A word walks its own path without an edit;
at every node from its middle on it also tries the other edges with one replaced, inserted or deleted
character, and from there it only follows exact edges, one join a level. A state that uses up its word
at the end of another word is a pair. What is left of a state's word is known, so the word that it
looks for is known too: an edge carries a filter of 64 bits of the words behind it, and a state whose
word is not in the filter cannot end in a pair and goes no further. An edit in the first half of a word is one in the second half
of the reversed word, so every word is in the trie twice, forwards behind ``>`` and backwards behind
``<``, and no word fans out near the root, where all words meet.

Memory and shuffles follow the number of distinct words. Every level is written to the shared folder.
Null and empty texts have no words; a null id counts as an empty one; repeated rows count as often as
they are there; an empty table gives an empty result; a word as long as a whole text is a word as any
other. Columns other than the id and the text are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundwork.session import written_once

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_TIMES, TIMES_OVER, EVERY = 7, 2, 10, 31


def _part(text: str | Column, begin: Column, length: Column) -> Column:
    """``length`` characters of ``text`` after the first ``begin``."""
    column = F.col(text) if isinstance(text, str) else text
    return column.substr(begin + 1, length)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n``: the runs of letters after the deletions that a checksum of id and run calls for."""
    found = F.regexp_extract_all(F.coalesce(docs[text].cast("string"), F.lit("")), F.lit(f"{LETTERS}{{{LEAST_LETTERS},}}"), F.lit(0))
    runs = docs.select(F.coalesce(docs[key].cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    ascii_only = F.length("run") == F.octet_length("run")
    lowered = runs.select("id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    checked = lowered.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.col("h") % F.length("run")
    cut = F.concat(_part("run", F.lit(0), at), _part("run", at + 1, F.length("run")))
    words = checked.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_TIMES)


def _common(a: str, b: str) -> Column:
    """Length of the longest common prefix."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.length(a)).cast("int")


def _bit(text: Column) -> Column:
    """The bit of a word in the filter of an edge."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(text), F.lit(64)).cast("int"))


def _hopeful(states: DataFrame) -> DataFrame:
    """States whose word, with the edit made, may be one of those behind their edge."""
    wanted = F.concat("child", _part("text", F.col("at"), F.length("text")))
    return states.where(F.col("below").bitwiseAND(_bit(wanted)) != 0).drop("below")


def _edges(own: DataFrame) -> DataFrame:
    """Edges out of the nodes that the words of ``own`` stand at: ``node``, ``step``, ``child``, ``leaf``, ``n``.

    Further ``below``, the filter of the words behind the edge, and ``shortest`` and ``longest``, their least and greatest length.
    """
    grouped = own.groupBy("step", "depth").agg(
        F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"), F.min("text").alias("low"), F.max("text").alias("high"),
        F.bit_or(_bit(F.col("text"))).alias("below"), F.min(F.length("text")).alias("shortest"), F.max(F.length("text")).alias("longest"))
    leaf = F.col("words") == 1
    child = F.when(leaf, F.col("low")).otherwise(_part("low", F.lit(0), _common("low", "high")))
    return grouped.select(_part("step", F.lit(0), F.col("depth")).alias("node"), "step", child.alias("child"), leaf.alias("leaf"), "n", "below", "shortest", "longest")


def _standing(words: DataFrame) -> DataFrame:
    """Words (``text``, ``n``, ``half``) at a node of ``depth`` characters, with the step they take from it."""
    return words.select("text", "n", "half", "depth", _part("text", F.lit(0), F.col("depth") + 1).alias("step"))


def _parted(own: DataFrame, edges: DataFrame) -> DataFrame:
    """States after the one edit, made where a word leaves its own path."""
    here = own.where("depth >= half").select(
        "text", "depth", F.length("text").alias("letters"), F.col("step").alias("taken"), _part("text", F.lit(0), F.col("depth")).alias("node"))
    tried = here.join(edges, "node").where("step <> taken and shortest <= letters + 1 and longest >= letters - 1")
    depth, size, letters = F.col("depth"), F.length("child"), F.col("letters")
    label = size - depth
    rest = _part("child", depth + 1, label - 1)  # the edge behind its first character

    def wanted(more: int) -> Column:
        return (F.col("shortest") <= letters + more) & (F.col("longest") >= letters + more)

    ends = F.array(
        F.when(wanted(0) & (label > 0) & (letters >= size) & (rest == _part("text", depth + 1, label - 1)), size),
        F.when(wanted(1) & (label > 0) & (letters >= size - 1) & (rest == _part("text", depth, label - 1)), size - 1),
        F.when(wanted(-1) & (letters >= size + 1) & (_part("child", depth, label) == _part("text", depth + 1, label)), size + 1))
    return _hopeful(tried.select("text", "child", "leaf", "n", "below", F.explode(ends).alias("at")).where("at is not null"))


def _followed(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States one exact edge further; where a word is used up the edge of a word that ends there."""
    step = F.concat("child", _part("text", F.col("at"), F.lit(1)))
    moving = states.select("text", "at", F.col("child").alias("node"), step.alias("step"))
    on = moving.join(edges.select("step", F.col("node").alias("from"), "child", "leaf", "n", "below"), "step").where(F.col("from") == F.col("node"))
    label = F.length("child") - F.length("node")
    same = _part("child", F.length("node"), label) == _part("text", F.col("at"), label)
    return _hopeful(on.where(same).select("text", "child", "leaf", "n", "below", (F.col("at") + label).alias("at")))


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``near`` and ``near_n`` for all ordered pairs of words one edit apart; ``words`` has distinct ``word`` and ``n``."""
    size, half = F.length("word"), F.floor(F.length("word") / 2).cast("int")
    ways = F.array(
        F.struct(F.concat(F.lit(">"), "word").alias("text"), (half + 1).alias("half")),
        F.struct(F.concat(F.lit("<"), F.reverse("word")).alias("text"), (size - half + 1).alias("half")))
    both = words.select("n", F.inline(ways)).withColumn("depth", F.lit(1))
    own = written_once(_standing(both), "trie-words")
    states, pairs = None, []
    while True:
        edges = written_once(_edges(own), "trie-edges")
        made = _parted(own, edges)
        if states is not None:
            made = made.unionByName(_followed(states, edges))
        ended = F.col("at") == F.length("text")
        made = written_once(made.where(~F.col("leaf") | ended), "trie-states")
        pairs.append(made.where("leaf").select("text", "child", "n"))
        states = made.where("not leaf")
        moved = own.join(edges.where("not leaf").select("step", "child"), "step")
        own = written_once(_standing(moved.select("text", "n", "half", F.length("child").alias("depth"))), "trie-words")
        if own.isEmpty():
            break
    found = reduce(DataFrame.unionByName, pairs)

    def plain(name: str) -> Column:
        bare = _part(name, F.lit(1), F.length(name))
        return F.when(F.col(name).startswith(">"), bare).otherwise(F.reverse(bare))

    return found.select(plain("text").alias("word"), plain("child").alias("near"), F.col("n").alias("near_n")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for words with a form; the frequency grows at every step, so paths are short and have an end."""
    roots = written_once(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        further = written_once(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        roots = further.select("word", "root")
        if further.where("moved").isEmpty():
            return roots


def spelling_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word.

    A word's form is the most frequent word one edit away (ties: smallest in code-point order) if that
    is at least ten times as frequent; its root is where forms lead in the end, so words with one root
    are spellings of one word.
    """
    words = written_once(word_counts(docs, key, text), "spelling-words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first"))
    joined = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("first.near").alias("near"), (-F.col("first.less")).alias("most"))
    often = F.col("most") >= TIMES_OVER * F.col("n")
    formed = written_once(joined.select(
        "word", F.when(often, F.col("near")).alias("form"), "n", "n_near", F.when(often, F.col("most")).alias("form_n")), "spelling-forms")
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
