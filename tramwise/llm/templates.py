"""Line dedup with a tree of line templates.

Lines are parsed by a tree of fixed depth: the number of tokens, then the leading
tokens, where a token with a digit counts as variable. In a leaf of that tree a token
is constant in a line if a third of the leaf's lines have it there, or a third of those
that have its left neighbour, or its right one: values of a variable field differ where all
else agrees, however many lines there are. All others are variable fields. The line with its
variable fields blanked is its template. A template that enough documents share recurs:
its first line stays, the others are dropped.

Long lines that are the same to the letter recur from two documents on. Where they make up
half of a document or more, the document is a copy, which is left to document dedup.

Everything is DataFrame code. Leaves with few lines, most of them, are put aside
before any text moves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramwise.llm.common import WORD, stage

BLANKS = r"[\x09\x0B-\x0D]"
VARIABLE, FIELD = "<*>", "<?>"
#: Up to so many busy leaves (8 bytes each) are broadcast; more are joined by a shuffle.
FEW_LEAVES = 500_000


@dataclass(frozen=True)
class Tree:
    """Shape of the tree, and what recurs."""

    depth: int = 3  # leading tokens that choose the leaf
    documents: int = 10  # that share a recurring template, at least
    agree: int = 3  # a constant stands in one of so many lines of its leaf or neighbour
    constant: float = 0.6  # share of tokens of a template that are no field, at least
    words: float = 0.3  # share of tokens that are constant and have no digit, at least
    long: int = 50  # characters of a line that recurs from two documents on


def _tokens(line: Column) -> Column:
    """Words between blanks, tabs and the like, of which most lines have blanks only."""
    plain = F.when(line.rlike(BLANKS), F.regexp_replace(line, BLANKS, " ")).otherwise(line)
    return F.filter(F.split(plain, " "), lambda t: t != "")


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), VARIABLE).otherwise(t))


def _lines(docs: DataFrame, tree: Tree) -> DataFrame:
    """Every line that has a token, with its leaf."""
    return (
        docs.select("doc_id", "mark", F.posexplode(F.split("text", "\n")).alias("line", "words"))
        .where(F.col("words").rlike(WORD))  # before lines are split, or they are split twice
        .withColumn("words", _tokens(F.col("words")))
        .withColumn("leaf", F.xxhash64(F.size("words"), _masked(F.slice("words", 1, tree.depth))))
    )


def line_templates(distinct: DataFrame, tree: Tree) -> DataFrame:
    """(leaf, key, template) of the lines that have one.

    ``distinct`` has leaf, key, words and how many ``times`` each different line occurs.
    """
    words = F.col("words")
    placed = distinct.select(
        "leaf", "key", "times", "words", F.posexplode("words").alias("at", "word")
    ).select(
        "leaf",
        "key",
        "times",
        "at",
        F.xxhash64("leaf", "at", "word").alias("a"),
        F.when(F.get(words, F.col("at") + 1).isNotNull(), F.xxhash64("leaf", F.col("at") + 1, F.get(words, F.col("at") + 1))).alias("b"),
    )
    # Tokens of the path to the leaf need no neighbour.
    placed = placed.where(F.col("at") >= tree.depth - 1)
    own = placed.groupBy("a").agg(F.sum("times").alias("own"), F.first("leaf").alias("leaf"))
    total = distinct.groupBy("leaf").agg(F.sum("times").alias("total"))
    wide = (
        own.join(total, "leaf")
        .where(F.col("own") * tree.agree >= F.col("total"))
        .groupBy("leaf")
        .agg(F.collect_set("a").alias("wide"))
    )
    own = own.drop("leaf")
    beside = placed.where("b is not null")
    both = beside.groupBy("a", "b").agg(F.sum("times").alias("both")).where("both > 1")
    told = (
        both.join(own, "a")
        .join(own.select(F.col("a").alias("b"), F.col("own").alias("next_own")), "b")
        .select(
            "a",
            "b",
            (F.col("both") * tree.agree >= F.col("next_own")).alias("first"),
            (F.col("both") * tree.agree >= F.col("own")).alias("second"),
        )
        .where("first or second")
    )
    constant = (
        beside.join(told, ["a", "b"])
        .select(
            "leaf",
            "key",
            F.explode(
                F.array_compact(F.array(F.when(F.col("first"), F.col("at")), F.when(F.col("second"), F.col("at") + 1)))
            ).alias("at"),
        )
        .groupBy("leaf", "key")
        .agg(F.collect_set("at").alias("constant"))
    )
    known = F.coalesce("constant", F.array().cast("array<int>"))
    common = F.coalesce("wide", F.array().cast("array<bigint>"))

    def kept(word, at):
        found = F.array_contains(known, at) | F.array_contains(common, F.xxhash64("leaf", at, word))
        return (at < tree.depth) | (word == VARIABLE) | found

    return (
        distinct.join(constant, ["leaf", "key"], "left")
        .join(wide, "leaf", "left")
        .withColumn("shape", F.transform(words, lambda w, i: F.when(kept(w, i), w).otherwise(FIELD)))
        .withColumn("n", F.size("shape"))
        .withColumn("masked", F.size(F.filter("shape", lambda w: w == VARIABLE)))
        .withColumn("fields", F.size(F.filter("shape", lambda w: w == FIELD)))
        .withColumn("plain", F.col("n") - F.col("masked") - F.col("fields"))
        .where(F.col("n") - F.col("fields") >= tree.constant * F.col("n"))
        .where(F.col("plain") >= tree.words * F.col("n"))
        .where("masked = 0 or plain > 1")
        .select("leaf", "key", F.xxhash64("shape").alias("template"))
    )


def recurring_lines(docs: DataFrame, tree: Tree) -> DataFrame:
    """(doc_id, mark, line): lines whose template recurs. ``docs`` has doc_id, mark and text."""
    lines = _lines(docs, tree)
    busy = stage(
        lines.groupBy("leaf").count().where(F.col("count") >= tree.documents).select("leaf"), "leaves"
    )
    few = busy.count() <= FEW_LEAVES
    kept = stage(
        lines.join(F.broadcast(busy) if few else busy, "leaf")
        .withColumn("words", _masked(F.col("words")))
        .withColumn("key", F.xxhash64("words")),
        "busy-lines",
    )
    # One row for each different line; a line that half of all documents have counts,
    # but is parsed once.
    distinct = stage(
        kept.groupBy("leaf", "key").agg(F.count("*").alias("times"), F.first("words").alias("words")),
        "distinct-lines",
    )
    found = stage(
        kept.select("doc_id", "mark", "line", "leaf", "key")
        .join(line_templates(distinct, tree), ["leaf", "key"])
        .select("doc_id", "mark", "line", "leaf", "template"),
        "template-lines",
    )
    return _later(found, ["leaf", "template"], tree.documents).select("doc_id", "mark", "line")


def _later(found: DataFrame, keys: list[str], documents: int) -> DataFrame:
    """Lines after the first of each key that enough documents share."""
    # By key and document first, so that no key gathers all its lines.
    shared = (
        found.groupBy(*keys, "doc_id", "mark")
        .agg(F.min("line").alias("line"))
        .groupBy(*keys)
        .agg(F.count("*").alias("documents"), F.min(F.struct("doc_id", "mark", "line")).alias("first"))
        .where(F.col("documents") >= documents)
    )
    later = ~F.struct("doc_id", "mark", "line").eqNullSafe(F.col("first"))
    return found.join(shared, keys).where(later)


def repeated_lines(docs: DataFrame, tree: Tree) -> DataFrame:
    """(doc_id, mark, line): long lines that an earlier document has word for word.

    Not those of documents that consist of them by half.
    """
    lines = (
        docs.select(
            "doc_id",
            "mark",
            F.char_length("text").alias("whole"),
            F.posexplode(F.split("text", "\n")).alias("line", "own"),
        )
        .withColumn("size", F.char_length("own"))
        .where(F.col("size") >= tree.long)
        .select("doc_id", "mark", "whole", "line", "size", F.xxhash64("own").alias("key"))
    )
    lines = stage(lines, "long-lines")
    again = lines.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    found = stage(_later(lines.join(again, "key"), ["key"], 2).select("doc_id", "mark", "whole", "line", "size"), "repeated-lines")
    # Rows that agree in id and text are one document.
    found = found.distinct()
    part = (
        found.groupBy("doc_id", "mark")
        .agg(F.sum("size").alias("gone"), F.first("whole").alias("whole"))
        .where(F.col("gone") * 2 < F.col("whole"))
        .select("doc_id", "mark")
        .alias("p")
    )
    f = found.alias("f")
    same = F.col("f.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("f.mark") == F.col("p.mark"))
    return f.join(part, same, "left_semi").select("doc_id", "mark", "line")


def drop_recurring(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """``docs`` without the lines whose template recurs across documents.

    All columns of ``docs`` stay, with ``text`` put together from the lines left, and
    ``n_lines`` and ``n_dropped`` are added (in place of columns of these names). Lines
    end at line feeds. Blank lines stay. The first line of a template is that of the
    least doc_id, NULL before all, and there the earliest. A NULL text stays NULL and has
    no lines; an empty one has one. Rows that agree in doc_id and text are one document.
    Two variable fields side by side whose values go together count as one constant.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    parsed = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    drops = (
        recurring_lines(parsed, tree)
        .unionByName(repeated_lines(parsed, tree))
        .groupBy("doc_id", "mark")
        .agg(F.collect_set("line").alias("gone"))
        .alias("g")
    )
    d = docs.alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.mark"))
    lines = F.split("d.text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("g.gone"))
    text = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    )
    return d.join(drops, same, "left").select(
        *[text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in own],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("g.gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


ORACLE_SQL = r"""
with lines as (
  select doc_id, line - 1 as line, own, list_filter(regexp_split_to_array(own, '[\x20\x09-\x0D]+'), lambda t: t <> '') as words
  from (select doc_id, unnest(string_split(text, chr(10))) as own, generate_subscripts(string_split(text, chr(10)), 1) as line from documents)
), masked as (
  select doc_id, line, list_transform(words, lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) as words
  from lines where len(words) > 0
), leaves as (
  select *, (len(words), words[1:3]) as leaf from masked
), busy as (
  select *, count(*) over (partition by leaf) as many from leaves qualify many >= 10
), placed as (
  select doc_id, line, leaf, many, words, unnest(words) as word, generate_subscripts(words, 1) as place from busy
), beside as (
  select *, words[place + 1] as after, words[place - 1] as before from placed
), own as (
  select leaf, place, word, count(*) as n from placed group by all
), both_sides as (
  select leaf, place, word, after, count(*) as n from beside where after is not null group by all
), told as (
  select b.doc_id, b.line, b.leaf, b.place, b.word,
    b.place <= 3 or b.word = '<*>'
      or 3 * o.n >= b.many
      or coalesce(r.n > 1 and 3 * r.n >= ro.n, false)
      or coalesce(b.place > 3 and l.n > 1 and 3 * l.n >= lo.n, false) as kept
  from beside b
  left join both_sides r on r.leaf = b.leaf and r.place = b.place and r.word = b.word and r.after = b.after
  join own o on o.leaf = b.leaf and o.place = b.place and o.word = b.word
  left join own ro on ro.leaf = b.leaf and ro.place = b.place + 1 and ro.word = b.after
  left join both_sides l on l.leaf = b.leaf and l.place = b.place - 1 and l.word = b.before and l.after = b.word
  left join own lo on lo.leaf = b.leaf and lo.place = b.place - 1 and lo.word = b.before
), templates as (
  select doc_id, line, leaf, list(case when kept then word else '<?>' end order by place) as template
  from told group by doc_id, line, leaf
  having count(*) filter (where kept) >= 0.6 * count(*)
    and count(*) filter (where kept and word <> '<*>') >= 0.3 * count(*)
    and (count(*) filter (where word = '<*>') = 0 or count(*) filter (where kept and word <> '<*>') > 1)
), recurring as (
  select template, min((doc_id, line)) as first from templates
  group by all having count(distinct doc_id) >= 10
), long as (
  select doc_id, line, own from lines where length(own) >= 50
), again as (
  select own, min((doc_id, line)) as first from long group by own having count(distinct doc_id) > 1
), repeated as (
  select doc_id, line, length(own) as size from long join again using (own) where (doc_id, line) <> first
), part as (
  select doc_id from repeated join documents using (doc_id) group by doc_id, text having 2 * sum(size) < length(text)
), gone as (
  select doc_id, line from templates join recurring using (template) where (doc_id, line) <> first
  union
  select doc_id, line from repeated where doc_id in (select doc_id from part)
)
select d.doc_id, any_value(len(string_split(d.text, chr(10)))) as n_lines, count(g.line) as n_dropped,
  case when count(g.line) = 0 then any_value(d.text)
       else coalesce(string_agg(l.own, chr(10) order by l.line) filter (where g.line is null), '') end as text
from documents d
join (select doc_id, unnest(string_split(text, chr(10))) as own, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents) l using (doc_id)
left join gone g on g.doc_id = l.doc_id and g.line = l.line
group by d.doc_id
"""
