"""Repair of the turns of conversations by a fold that carries the cheapest edits to each state of the expected form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What counts as blank.
BLANKS = " \t\n\x0b\x0c\r"
#: Costs of edits; CUT is added for a truncated turn that stays.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Where a conversation may be: nothing yet, after a system turn, after a user's, after an assistant's.
STATES = ("n", "s", "u", "a")
NEVER = 1 << 50
#: Turns that are collected into one row.
BLOCK = 512


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults that crc32 of conv_id:turn deals out: one turn in 20 each is dropped, emptied, loses its ends of sentences, is repeated, or becomes the user's.

    Nulls count as one space. Repeated rows stay; other columns are left out.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long"), plain("role").alias("role"), plain("text").alias("text"), fate.alias("fate")).where("fate != 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def flagged(rows: DataFrame) -> DataFrame:
    """Turns with their number `at` in the conversation (from 0), role's initial, first fault, and what they add to the counts.

    The order is by turn, nulls first; turns with one number by role and text. One exchange, by conv_id; windows spill.
    """
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    w = W.partitionBy("conv_id").orderBy(*order)
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.select("conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), (F.row_number().over(w) - 1).cast("long").alias("at"), F.lag("turn").over(w).alias("before"), F.lag(F.substring("role", 1, 1)).over(w).alias("past"))
    seen = F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy("at")) > 1
    fault = F.when(body == "", "blank").when(seen, "duplicate").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    pair = F.concat("past", "initial")
    return rows.select("conv_id", "at", "turn", "role", "text", "initial", fault.alias("fault"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("before"))).alias("other"), F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is worked out once."""
    return F.transform(F.array(value), then)[0]


def _inserted(x: Column) -> Column:
    """The states after any insertions that may pay: of one turn, or of a user's and an assistant's."""
    more = lambda s: F.struct((s["c"] + INSERT).alias("c"), F.concat(s["p"], F.lit("I")).alias("p"))
    user = F.least(x["u"], more(F.least(x["n"], x["s"], x["a"])))
    return _bound(user, lambda u: F.struct(x["n"].alias("n"), x["s"].alias("s"), u.alias("u"), F.least(x["a"], more(u)).alias("a")))


def _taken(x: Column, t: Column) -> Column:
    """The states after a turn: deleted, kept, or given the other role."""
    gone, cut = t["fault"].isin("blank", "duplicate"), F.when(t["fault"] == "truncated", CUT).otherwise(0)
    after = lambda s, cost, letter: F.struct((s["c"] + cost).cast("long").alias("c"), F.concat(s["p"], letter).alias("p"))
    deleted = lambda s: after(s, F.lit(DELETE), F.lit("D"))

    def emitted(s: Column, initial: str) -> Column:
        own = t["initial"] == initial
        return F.when(~gone, after(s, cut + F.when(own, 0).otherwise(REROLE), F.when(own, "K").otherwise("R")))

    system = F.when(~gone & (t["initial"] == "s"), after(x["n"], cut, F.lit("K")))
    return F.struct(
        deleted(x["n"]).alias("n"),
        F.least(deleted(x["s"]), system).alias("s"),
        F.least(deleted(x["u"]), emitted(F.least(x["n"], x["s"], x["a"]), "u")).alias("u"),
        F.least(deleted(x["a"]), emitted(x["u"], "a")).alias("a"),
    )


def _start(state: str) -> Column:
    return F.struct(*[F.struct(F.lit(0 if s == state else NEVER).cast("long").alias("c"), F.lit("").alias("p")).alias(s) for s in STATES])


def _folded(turns: Column, state: str) -> Column:
    """From one state before a block of turns, the cheapest edits to each state after it, and of these the ASCII-least."""
    return F.aggregate(turns, _start(state), lambda x, t: _bound(_inserted(x), lambda y: _taken(y, t)))


def _joined(x: Column, block: Column) -> Column:
    """The states after one more block: x holds cost, edits and, for each block, where its edits end and in which state.

    Edits of one cost and of as many turns are never a beginning of each other, so the least of the parts is the least of the whole.
    """
    to = lambda s: F.least(*[F.struct((x[i]["c"] + block[i][s]["c"]).alias("c"), F.concat(x[i]["p"], block[i][s]["p"]).alias("p"), F.concat(x[i]["q"], F.array(F.struct(F.length(F.concat(x[i]["p"], block[i][s]["p"])).alias("end"), F.lit(s).alias("state")))).alias("q")) for i in STATES])
    return F.struct(*[to(s).alias(s) for s in STATES])


def _rewritten(block: Column) -> Column:
    """role and text of the turns that a block's edits leave or insert. Users and assistants take turns, but for a system turn that is kept at the start."""
    edits, turns = block["edits"], block["turns"]
    upto = lambda i, letter: F.length(F.translate(F.substring(edits, F.lit(1), i), letter, ""))
    row = lambda i: F.try_element_at(turns, upto(i, "I"))
    first = F.substring(F.translate(edits, "D", ""), 1, 1)
    kept = F.length(F.substring_index(edits, "K", 1)) + 1
    system = (block["state"] == "n") & (first == "K") & (row(kept)["initial"] == "s")

    def turn(i: Column) -> Column:
        user = (upto(i, "D") + F.when(system, 1).otherwise(0) + F.when(block["state"] == "u", 1).otherwise(0)) % 2 == 1
        letter = F.substring(edits, i, F.lit(1))
        own = F.when(user, "user").otherwise("assistant")
        return F.struct(F.when(letter == "K", row(i)["role"]).otherwise(own).alias("role"), F.when(letter == "I", "").otherwise(row(i)["text"]).alias("text"))

    places = F.filter(F.sequence(F.lit(1), F.length(edits)), lambda i: F.substring(edits, i, F.lit(1)) != "D")
    return F.when(F.length(edits) > 0, F.transform(places, turn)).otherwise(F.array().cast("array<struct<role:string,text:string>>"))


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits of each conversation, and its turns after them.

    rows holds conv_id, turn, role and text (no nulls in the last two). A turn's first fault counts: blank, duplicate (role
    and text seen earlier in the conversation), truncated. Edits are Keep, Rerole, Delete (the only one for blank and
    duplicate turns) and Insert; what is left must be nothing, or user and assistant in turn, an assistant last, after a
    system turn or none. An empty role has no initial and can't stay. Of edits of one cost those whose initials are ASCII-least are taken.

    First result: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Second: conv_id, block (from 0) and
    turns (role and text, in order) of each block of about BLOCK turns; blocks without turns left are there as well.

    Turns are collected by blocks, whose folds from all four states are small, and joined in order for each conversation; so
    a conversation of any length takes a row of some 16 bytes a turn at one time, never its texts. A null conv_id is a
    conversation; an empty table gives empty results; other columns are ignored.
    """
    turns = flagged(rows).withColumn("block", F.expr(f"at div {BLOCK}"))
    told = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")] + [F.count_if("illegal").alias("illegal"), F.count_if("other").alias("others"), F.min("turn").alias("low"), F.max("turn").alias("high")]
    small = F.array_sort(F.collect_list(F.struct("at", "initial", "fault")))
    folds = turns.groupBy("conv_id", "block").agg(small.alias("turns"), *told)
    fold = F.struct(*[F.when((F.col("block") == 0) & F.lit(s != "n"), _start(s)).otherwise(_folded(F.col("turns"), s)).alias(s) for s in STATES])
    folds = folds.withColumn("fold", fold)
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    by_conv = folds.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "fold"))).alias("folds"), *sums, F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("others"), F.lit(0)).alias("gaps"))
    start = F.struct(*[F.struct(F.lit(0 if s == "n" else NEVER).cast("long").alias("c"), F.lit("").alias("p"), F.array().cast("array<struct<end:int,state:string>>").alias("q")).alias(s) for s in STATES])
    by_conv = by_conv.withColumn("end", F.aggregate("folds", start, lambda x, b: _joined(x, b["fold"])))
    more = lambda s, n: F.struct((s["c"] + n * INSERT).alias("c"), F.concat(s["p"], F.lit("I" * n)).alias("p"), s["q"].alias("q"))
    e = F.col("end")
    best = F.least(e["n"], e["a"], more(e["u"], 1), more(F.least(e["n"], e["s"], e["a"]), 2))
    by_conv = by_conv.withColumn("best", best).drop("folds", "end")
    audit = by_conv.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.c").alias("cost"), F.col("best.p").alias("audit"))
    ends = F.col("best.q")
    begin = lambda i: F.when(i > 1, F.try_element_at(ends, i - 1)["end"]).otherwise(0)
    stop = lambda i: F.when(i == F.size(ends), F.length("best.p")).otherwise(F.try_element_at(ends, i)["end"])
    piece = lambda i: F.struct((i - 1).cast("long").alias("block"), F.substring(F.col("best.p"), begin(i) + 1, stop(i) - begin(i)).alias("edits"), F.when(i > 1, F.try_element_at(ends, i - 1)["state"]).otherwise("n").alias("state"))
    edits = by_conv.select(F.col("conv_id").alias("c"), F.explode(F.transform(F.sequence(F.lit(1), F.size(ends)), piece)).alias("e")).select("c", F.col("e.block").alias("b"), "e.edits", "e.state")
    whole = turns.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("at", "initial", "role", "text"))).alias("turns"))
    both = whole.join(edits, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return audit, both.select("conv_id", "block", _rewritten(F.struct("edits", "state", "turns")).alias("turns"))


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation, whose turns are damaged first.

    The digest is of role:text of all turns, joined by newlines, which is one string (of 2 GB at most) at that point. A conversation
    of which no turn is left has zeros, no audit, and the empty string's digest.
    """
    audit, parts = repaired(damaged(conversations))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    text = parts.where(F.size("turns") > 0).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", line.alias("p")))).alias("p"))
    text = text.select(F.col("conv_id").alias("t"), F.array_join(F.transform("p", lambda x: x["p"]), "\n").alias("text"))
    ids = conversations.select("conv_id").distinct()
    audit = audit.withColumnRenamed("conv_id", "c")
    out = ids.join(audit, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(text, F.col("conv_id").eqNullSafe(F.col("t")), "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("repaired_sha256"))


#: The rows of `digests`, for DuckDB: crc32 from its polynomial, and the fold as a recursion over the turns.
ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)) + 0 * z) AS c FROM (SELECT unnest(range(256))::BIGINT AS i))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))::BLOB AS key FROM conversations
), fated AS (
  SELECT k.*, xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(key)::BIGINT), lambda i: ('0x' || substr(hex(key), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS fate FROM keyed k, crc_table
), dealt AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, (SELECT unnest([1, 2]) AS time) WHERE fate != 0 AND (time = 1 OR fate = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM dealt
), marked AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM placed
), fold AS (
  SELECT conv_id, 0::BIGINT AS pos, {'c': 0, 'p': '', 'r': ''} AS n, {'c': 1000000000, 'p': '', 'r': ''} AS s, {'c': 1000000000, 'p': '', 'r': ''} AS u, {'c': 1000000000, 'p': '', 'r': ''} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, {'c': n.c + 2, 'p': n.p || 'D', 'r': n.r},
    CASE WHEN stays AND initial = 's' AND (n.c + cut, n.p || 'K') < (s.c + 2, s.p || 'D') THEN {'c': n.c + cut, 'p': n.p || 'K', 'r': line} ELSE {'c': s.c + 2, 'p': s.p || 'D', 'r': s.r} END,
    CASE WHEN stays AND (v.c + cut + (initial != 'u')::INTEGER, v.p || ku) < (iu.c + 2, iu.p || 'D') THEN {'c': v.c + cut + (initial != 'u')::INTEGER, 'p': v.p || ku, 'r': v.r || CASE v.r WHEN '' THEN '' ELSE chr(10) END || CASE initial WHEN 'u' THEN line ELSE 'user:' || text END} ELSE {'c': iu.c + 2, 'p': iu.p || 'D', 'r': iu.r} END,
    CASE WHEN stays AND (iu.c + cut + (initial != 'a')::INTEGER, iu.p || ka) < (ia.c + 2, ia.p || 'D') THEN {'c': iu.c + cut + (initial != 'a')::INTEGER, 'p': iu.p || ka, 'r': iu.r || chr(10) || CASE initial WHEN 'a' THEN line ELSE 'assistant:' || text END} ELSE {'c': ia.c + 2, 'p': ia.p || 'D', 'r': ia.r} END
  FROM (
    SELECT *, list_sort([n, s, ia])[1] AS v FROM (
      SELECT *, list_sort([a, {'c': iu.c + 5, 'p': iu.p || 'I', 'r': iu.r || chr(10) || 'assistant:'}])[1] AS ia FROM (
        SELECT f.*  EXCLUDE (pos), m.pos, m.initial, m.text, m.role || ':' || m.text AS line, m.fault NOT IN ('blank', 'duplicate') AS stays, CASE m.fault WHEN 'truncated' THEN 5 ELSE 0 END AS cut,
          CASE m.initial WHEN 'u' THEN 'K' ELSE 'R' END AS ku, CASE m.initial WHEN 'a' THEN 'K' ELSE 'R' END AS ka,
          list_sort([u, {'c': w.c + 5, 'p': w.p || 'I', 'r': w.r || CASE w.r WHEN '' THEN '' ELSE chr(10) END || 'user:'}])[1] AS iu
        FROM (SELECT *, list_sort([n, s, a])[1] AS w FROM fold) f JOIN marked m ON m.conv_id IS NOT DISTINCT FROM f.conv_id AND m.pos = f.pos + 1
      )
    )
  )
), ended AS (
  SELECT conv_id, list_sort([n, a, {'c': u.c + 5, 'p': u.p || 'I', 'r': u.r || chr(10) || 'assistant:'}, {'c': s.c + 10, 'p': s.p || 'II', 'r': s.r || chr(10) || 'user:' || chr(10) || 'assistant:'}])[1] AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS back FROM fold) WHERE back = 1
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM marked GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  best.c::BIGINT AS cost, best.p AS audit, sha256(best.r) AS repaired_sha256
FROM ended e LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""
