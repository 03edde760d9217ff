"""F: claim and evidence verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.text import words, words_present
from plumbline.operators import claims as V
from plumbline.plans import fixtures as fx
from plumbline.plans.registry import query, table, view
from plumbline.session import cut

_EVIDENCE = """
select trace_id, 0 as claim_idx, e.ev_idx, e.row_idx, e.col
from {base} lateral view explode(filter(array(
       named_struct('ev_idx', 0, 'row_idx', 0, 'col', 'n_orders', 'used', n_orders not in (13, 14)),
       named_struct('ev_idx', 1, 'row_idx', 0, 'col', 'total', 'used', n_orders not in (13, 14)),
       named_struct('ev_idx', 2, 'row_idx', 0, 'col', 'top_status', 'used', n_orders not in (13, 14)),
       named_struct('ev_idx', 3, 'row_idx', 1, 'col', 'total', 'used', n_orders = 12),
       named_struct('ev_idx', 4, 'row_idx', 0, 'col', 'discount', 'used', n_orders = 11)), x -> x.used)) t as e
"""


def answer_tables(spark, sf, all_rows=False):
    """Answers, claims, evidence and cells; results of ten orders come back empty, unless ``all_rows`` asks for them too."""
    base = cut(view(spark, sf, fx.ANSWERS))  # four tables come from it
    answers = base.select(
        "trace_id", "question", F.col("claim_text").alias("text"), F.when(F.lit(not all_rows) & (F.col("n_orders") == 10), 0).otherwise(1).alias("row_count")
    )
    claims = base.where("n_orders <> 14").select(
        "trace_id", F.lit(0).alias("claim_idx"), F.col("claim_text").alias("text")
    )
    none = F.lit(None).cast("string")
    cells = (base if all_rows else base.where("n_orders <> 10")).select(
        "trace_id",
        F.lit(0).alias("row_idx"),
        F.explode(
            F.array(
                F.struct(F.lit("n_orders").alias("col"), F.lit("num").alias("kind"),
                         F.col("n_orders").cast("double").alias("num"), none.alias("str")),
                F.struct(F.lit("total").alias("col"), F.lit("num").alias("kind"),
                         F.col("total").cast("double").alias("num"), none.alias("str")),
                F.struct(F.lit("top_status").alias("col"), F.lit("str").alias("kind"),
                         F.lit(None).cast("double").alias("num"), F.col("top_status").alias("str")),
            )
        ).alias("c"),
    ).select("trace_id", "row_idx", "c.*")
    return answers, claims, spark.sql(_EVIDENCE, base=base), cells


_BAD_EVIDENCE = f"""
select trace_id, case when n_orders = 12 then 'Evidence row 1 does not exist'
                      else 'Evidence column ''discount'' does not exist in row 0' end as message
from ({fx.ANSWERS}) a where n_orders in (11, 12)
union all select trace_id, 'Evidence row 0 does not exist' from ({fx.ANSWERS}) a, (values (0), (1), (2)) v(i) where n_orders = 10
"""


@query("F01_evidence", _BAD_EVIDENCE)
def f01(spark, sf):
    answers, _, evidence, cells = answer_tables(spark, sf)
    return V.check_evidence(evidence, cells, answers).select("trace_id", "message")


@query(
    "F02_uncited",
    f"""
select trace_id, concat('Claim has no evidence: ', claim_text) as message from ({fx.ANSWERS}) a where n_orders = 13
union all
select trace_id, 'Answer text has no evidence-linked claims' from ({fx.ANSWERS}) a where n_orders = 14
""",
)
def f02(spark, sf):
    answers, claims, evidence, _ = answer_tables(spark, sf)
    alone = V.unclaimed_answers(answers, claims)
    return V.check_claims_cited(claims, evidence).select("trace_id", "message").unionByName(
        alone.select("trace_id", F.lit("Answer text has no evidence-linked claims").alias("message"))
    )


_NUMBERS = rf"""
select trace_id, replace(n, ',', '') as digits, cast(replace(n, ',', '') as double) as value,
       case when contains(n, '.') then length(split_part(n, '.', 2)) else 0 end as decimals, false as percent
from (select trace_id, unnest(regexp_extract_all(claim_text, '(\d[\d,]*(?:\.\d+)?)', 1)) as n
      from ({fx.ANSWERS}) a where n_orders <> 14) t
where length(n) <> 4
"""


@query("F03_numbers", _NUMBERS)
def f03(spark, sf):
    return V.claim_numbers(answer_tables(spark, sf)[1]).select("trace_id", "digits", "value", "decimals", "percent")


_DATED = """
select l_orderkey as trace_id, l_linenumber, l_partkey,
       concat('Part ', cast(l_partkey as varchar(20)), ' left on ', substr(cast(l_shipdate as varchar(30)), 1, 10),
              ' at ', cast(cast(l_discount * 100 as integer) as varchar(4)), '% off, see June 3, 2024 or 2031.') as text
from lineitem
"""


@query(
    "F04_dates_and_years",
    """
select l_orderkey as trace_id, cast(l_partkey as varchar) as digits, false as percent
from lineitem where length(cast(l_partkey as varchar)) <> 4
union all
select l_orderkey, cast(cast(l_discount * 100 as integer) as varchar), true from lineitem
""",
)
def f04(spark, sf):
    claims = view(spark, sf, _DATED).withColumn("claim_idx", F.col("l_linenumber"))
    return V.claim_numbers(claims).select("trace_id", "digits", "percent")


_SUPPORT = f"""
select n.trace_id, n.value,
       bool_or(abs(n.value - c.cell) <= case when n.decimals = 0 then 1e-9 else 0.5 * power(10, -n.decimals) end + 1e-12)
           as supported
from ({_NUMBERS}) n
join ({fx.ANSWERS}) a on a.trace_id = n.trace_id
join (select trace_id, cast(n_orders as double) as cell from ({fx.ANSWERS}) x
      union all select trace_id, cast(total as double) from ({fx.ANSWERS}) y) c on c.trace_id = n.trace_id
where n.digits <> cast(n.trace_id as varchar)
group by n.trace_id, n.value, a.n_orders
having a.n_orders not in (10, 13)
union all
select n.trace_id, n.value, false from ({_NUMBERS}) n join ({fx.ANSWERS}) a on a.trace_id = n.trace_id
where a.n_orders in (10, 13) and n.digits <> cast(n.trace_id as varchar)
"""


@query("F05_number_support", _SUPPORT)
def f05(spark, sf):
    answers, claims, evidence, cells = answer_tables(spark, sf)
    cited = V.cited_cells(evidence, cells)
    support = V.number_support(V.claim_numbers(claims), cited, answers)
    return support.select("trace_id", "value", "supported")


@query(
    "F06_question_numbers",
    f"select trace_id, cast(trace_id as varchar) as numbers from ({fx.ANSWERS}) a",
)
def f06(spark, sf):
    from plumbline.functions.text import question_numbers

    numbers = F.array_join(question_numbers(F.col("question")), ",")
    return view(spark, sf, fx.ANSWERS).select("trace_id", numbers.alias("numbers"))


_SAID = """
select d.doc_id as trace_id, d.text as said, concat(split_part(d.text, ' ', 2), ' ', split_part(d.text, ' ', 3)) as phrase,
       n.word
from documents d
left join (select doc_id - 1 as doc_id, split_part(text, ' ', 5) as word from documents) n on d.doc_id = n.doc_id
"""
_WORDS = "array_to_string(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[a-z0-9]+'), ' ')"


@query(
    "F07_text_present",
    f"""
select trace_id,
       phrase = '' or case when contains(phrase, ' ') then contains(said, phrase)
                           else contains(' ' || said || ' ', ' ' || phrase || ' ') end as phrase_present,
       word = '' or case when contains(word, ' ') then contains(said, word)
                         else contains(' ' || said || ' ', ' ' || word || ' ') end as word_present
from (select trace_id, {_WORDS.format('said')} as said, {_WORDS.format('phrase')} as phrase,
             {_WORDS.format('word')} as word from ({_SAID}) t) n
""",
)
def f07(spark, sf):
    said = view(spark, sf, _SAID).select(
        "trace_id",
        words(F.col("said")).alias("said"),
        words(F.col("phrase")).alias("phrase"),
        words(F.col("word")).alias("word"),
    )
    return said.select(
        "trace_id",
        words_present(F.col("phrase"), F.col("said")).alias("phrase_present"),
        words_present(F.col("word"), F.col("said")).alias("word_present"),
    )


@query(
    "F07_text_support",
    f"select trace_id, top_status as str, top < 480000 as present from ({fx.ANSWERS}) a where n_orders not in (13, 14)",
)
def f07_support(spark, sf):
    answers, _, evidence, cells = answer_tables(spark, sf, all_rows=True)
    return V.text_support(V.cited_cells(evidence, cells), answers).select("trace_id", "str", "present")


@query(
    "F08_evidence_present",
    f"select trace_id, 'evidence_present' as name, n_orders <> 10 as passed from ({fx.ANSWERS}) a where n_orders <> 14",
)
def f08(spark, sf):
    return f09(spark, sf).where("name = 'evidence_present'").select("trace_id", "name", "passed")


_FAILURES = f"""
select trace_id, 0 as ord, concat('Claim has no evidence: ', claim_text) as message, null as num from ({fx.ANSWERS}) a where n_orders = 13
union all select trace_id, -1, 'Answer text has no evidence-linked claims', null from ({fx.ANSWERS}) a where n_orders = 14
union all select trace_id, 1, message, null from ({_BAD_EVIDENCE}) b
union all select distinct trace_id, 2, case when value = floor(value) then concat(cast(cast(value as bigint) as varchar), '.0') else cast(value as varchar) end, value
          from ({_SUPPORT}) s where not supported
union all select trace_id, 3, top_status, null from ({fx.ANSWERS}) a where top >= 480000 and n_orders not in (10, 13, 14)
"""
# All failures of an answer in one text.
CLAIM_MESSAGES = f"""
select trace_id, sum(n) as n, string_agg(text, '; ' order by ord) as message
from (select trace_id, ord, count(*) as n,
             case ord when 2 then concat('Numeric claim is absent from cited evidence: ', string_agg(message, ', ' order by num))
                      when 3 then concat('Text claim is absent from cited evidence: ', string_agg(message, ', ' order by message))
                      else string_agg(message, '; ' order by message) end as text
      from ({_FAILURES}) f group by trace_id, ord) g
group by trace_id
"""


@query(
    "F09_verify_claims",
    f"""
with a as (select a.trace_id, n_orders, cast(coalesce(f.n, 0) as bigint) as n, coalesce(f.message, '') as message
           from ({fx.ANSWERS}) a left join ({CLAIM_MESSAGES}) f on a.trace_id = f.trace_id)
select trace_id, 1 as ordinal, 'claims_supported' as name, n = 0 as passed, n as n_failures, message from a
union all select trace_id, 0, 'evidence_present', n_orders <> 10, 0, case when n_orders = 10 then 'No evidence rows returned' else '' end
          from a where n_orders <> 14
union all select trace_id, 2, 'explanation_matches_sql', true, 0, 'Answer was constructed after execution from SQL and evidence' from a where n_orders <> 14
union all select trace_id, 3, 'date_boundaries_disclosed', true, 0, 'Boundaries are recorded in the interpretation' from a
union all select trace_id, 4, 'assumptions_disclosed', true, 0, 'Assumptions are recorded in the interpretation' from a
""",
)
def f09(spark, sf):
    return V.verify_claims(*answer_tables(spark, sf))


_STOP = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)
_ALIASED = "case x " + " ".join(f"when '{a}' then '{b}'" for a, b in fixed.WORD_ALIASES.items()) + " else x end"


def _weighty(text: str) -> str:
    return f"list_distinct(list_transform(list_filter(string_split({text}, ' '), lambda x: x <> '' and x not in ({_STOP})), lambda x: {_ALIASED}))"


# What containment and shared words decide; no other pair of these turns is similar enough.
@query(
    "F10_claim_covered",
    f"""
with n as (select u.conv_id, u.turn, {_WORDS.format('u.text')} as a, {_WORDS.format('r.text')} as b
           from conversations u join conversations r on r.conv_id = u.conv_id and r.turn = u.turn + 1 and r.role = 'assistant' where u.role = 'user'),
     w as (select *, {_weighty('a')} as wa, {_weighty('b')} as wb from n)
select conv_id, turn, contains(b, a) or contains(a, b) or coalesce(len(list_intersect(wa, wb)) > {fixed.SHARED_WORDS} * len(wa) and len(wa) > 0, false) as covered from w
""",
)
def f10(spark, sf):
    turns = table(spark, sf, "conversations")
    said = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("claim"))
    reply = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context")
    )
    return V.claim_covered(said.join(reply, ["conv_id", "turn"])).select("conv_id", "turn", "covered")
