"""Dataset construction and text splitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.functions.text import finalize, split_lines, split_sentences
from relweave.operators.dataset import batch_consecutive
from relweave.operators.extract import rule_extract
from relweave.plans import common as C
from relweave.plans.registry import query
from relweave.sources.tables import read_table


@query("render_rows", f"""SELECT c_custkey, domain, sentence FROM ({C.RENDERED_SQL}) r""")
def render_rows_q(spark, sf):
    return finalize(C.rendered(spark, sf).select("c_custkey", "domain", "sentence"))


@query("batch_entries", C.ENTRIES_SQL)
def batch_entries_q(spark, sf):
    return finalize(C.entries(spark, sf))


@query("roundtrip_extract", C.FACTS_SQL)
def roundtrip_extract_q(spark, sf):
    return finalize(rule_extract(C.entries(spark, sf)))


@query("paragraph_split", """SELECT d.doc_id, CAST(u.o - 1 AS BIGINT) AS para_pos, u.para
FROM documents d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS u(para, o)""")
def paragraph_split_q(spark, sf):
    d = read_table(spark, sf, "documents")
    return finalize(d.select("doc_id", F.posexplode(split_lines("text")).alias("para_pos", "para")))


SENTENCES_SQL = r"""SELECT d.doc_id, CAST(u.o - 1 AS BIGINT) AS sent_pos, u.s AS sentence
FROM documents d, unnest(list_filter(list_transform(
        string_split(regexp_replace(d.text, '\.\s+', '.' || chr(1), 'g'), chr(1)),
        lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''))
     WITH ORDINALITY AS u(s, o)"""


@query("sentence_split", SENTENCES_SQL)
def sentence_split_q(spark, sf):
    d = read_table(spark, sf, "documents")
    return finalize(d.select("doc_id", F.posexplode(split_sentences("text")).alias("sent_pos", "sentence")))


@query("batch_by_domain", f"""WITH r AS ({C.RENDERED_SQL}),
n AS (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY c_custkey) - 1) // {C.BATCH} AS entry_no FROM r)
SELECT domain, CAST(entry_no AS BIGINT) AS entry_no, string_agg(sentence, chr(10) ORDER BY c_custkey) AS text, min(c_custkey) AS first_key, count(*) AS n_rows,
       array_to_string(list_sort(list_distinct(flatten(list(attrs)))), ',') AS entities FROM n GROUP BY domain, entry_no""")
def batch_by_domain(spark, sf):
    """Five consecutive rows of one dataset to an entry."""
    return finalize(batch_consecutive(C.rendered(spark, sf), "c_custkey", C.CUST_COLS, C.BATCH))
