"""The registered queries of the reference's operators, each with its DuckDB twin."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived
from .functions import prompts, syntax
from .functions import text as T
from .functions import tokens as K
from .operators import decontam, dedup, filters, imports, joins, position, sanitize
from .operators.counted import Report
from .operators.saved import saved, scratch_path, spread
from .plans import chains, stages
from .sources import commits, files
from .streaming import resumable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
C, R, M = f"WITH {derived.CODE_CTE}", f"WITH {derived.RESPONSE_CTE}", f"WITH {derived.MODULE_CTE}"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.code(docs(spark, sf_dir))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.responses(docs(spark, sf_dir))


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed filter over documents: marker and line filters, decontamination, exact dedup."""
    rows = docs(spark, sf_dir).select("doc_id", "text").filter(~F.contains(F.lower("text"), F.lit("license")) & filters.few_lines(F.col("text")))
    return dedup.exact(decontam.decontaminate(rows, bench(spark, sf_dir).select("text"), "text"), "text", "doc_id").select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT min(doc_id) AS doc_id, CAST(length(text) AS BIGINT) AS n FROM documents d WHERE NOT contains(lower(text), 'license') AND len(string_split(text, chr(10))) <= 150 AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text <> '' AND contains(d.text, b.text)) GROUP BY text")
def seed_filter(spark, sf_dir):
    return flagship(spark, sf_dir)


# Filters over code.


@query(C + " SELECT doc_id FROM code WHERE NOT regexp_matches(lower(content), 'todo|fixme|bug|(import|from) (argparse|os|subprocess|sys|setuptools|distutils|matplotlib|seaborn)')")
def bad_substring_filter(spark, sf_dir):
    return code(spark, sf_dir).filter(filters.clean_words(F.col("content"))).select("doc_id")


@query(C + " SELECT doc_id FROM code WHERE len(string_split(content, chr(10))) <= 150")
def line_count_filter(spark, sf_dir):
    return code(spark, sf_dir).filter(filters.few_lines(F.col("content"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE len(string_split(text, chr(10))) <= 20")
def document_line_filter(spark, sf_dir):
    return docs(spark, sf_dir).filter(filters.few_lines(F.col("text"), 20)).select("doc_id")


@query(C + r" SELECT doc_id FROM code WHERE NOT regexp_matches(content, '(?m)^def [^\n]*\(\):')")
def no_arg_filter(spark, sf_dir):
    return code(spark, sf_dir).filter(filters.takes_arguments(F.col("content"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 12 IN (0, 1, 3, 4, 5, 6, 7, 8, 10, 11)")
def has_return_filter(spark, sf_dir):
    return code(spark, sf_dir).withColumn("f", syntax.code_features(F.col("content"))).filter("f.has_return").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 12 IN (0, 1, 2, 5, 6, 7, 8, 10, 11)")
def docstring_filter(spark, sf_dir):
    return code(spark, sf_dir).withColumn("f", syntax.code_features(F.col("content"))).filter(filters.has_docstring(F.col("f"))).select("doc_id")


#: The documented functions of derived.CODE, by variant.
_FUNCTIONS = {k: derived.CODE[k] for k in (0, 1, 2, 5, 7, 8, 10)} | {6: derived.CODE[6].removeprefix("import os\n\n"), 11: derived.CODE[11].removeprefix("@cache\n").replace("\n\nasync", "|async")}


@query(f"SELECT doc_id, CASE WHEN doc_id % 12 IN (3, 4, 9) THEN 0 WHEN doc_id % 12 = 11 THEN 2 ELSE 1 END AS n, coalesce({derived.case(_FUNCTIONS, n=12)}, '') AS functions FROM documents")
def extract_functions(spark, sf_dir):
    found = code(spark, sf_dir).select("doc_id", syntax.extract_functions(F.col("content")).alias("f"))
    return found.select("doc_id", F.size("f").alias("n"), F.array_join("f", "|").alias("functions"))


@query("SELECT doc_id, doc_id % 12 <> 9 AS ok, CASE doc_id % 12 WHEN 9 THEN NULL WHEN 10 THEN 'same' WHEN 11 THEN 'outer_' || doc_id || ' inner second_' || doc_id ELSE (['plus_', 'none_', 'quiet_', 'single_', 'bare_', 'later_', 'paths_', 'trace_', 'long_'])[1 + doc_id % 12] || doc_id END AS names FROM documents")
def function_names(spark, sf_dir):
    return code(spark, sf_dir).withColumn("f", syntax.code_features(F.col("content"))).select("doc_id", F.col("f.parses").alias("ok"), F.col("f.function_names").alias("names"))


@query("SELECT doc_id FROM documents WHERE doc_id % 12 IN (0, 10, 11)")
def static_filters(spark, sf_dir):
    return stages.static_filters(code(spark, sf_dir), bench(spark, sf_dir).select("text")).select("doc_id")


# Decontamination.


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text <> '' AND contains(d.text, b.text))")
def decontaminate(spark, sf_dir):
    return decontam.decontaminate(docs(spark, sf_dir).select("doc_id", "text"), bench(spark, sf_dir).select("text"), "text").select("doc_id")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)")
def contaminated_pairs(spark, sf_dir):
    return decontam.contaminated_pairs(docs(spark, sf_dir).select("doc_id", "text"), bench(spark, sf_dir), "text").select("doc_id", F.col("bench_item_id").alias("item_id"))


@query("SELECT CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS name, count(*) AS n FROM benchmark WHERE trim(text) <> '' GROUP BY 1")
def benchmark_counts(spark, sf_dir):
    b = bench(spark, sf_dir)
    sets = [decontam.named("even", b.filter("item_id % 2 = 0"), "text"), decontam.named("odd", b.filter("item_id % 2 = 1"), "text")]
    return decontam.counts(decontam.registry(sets))


@query("WITH j AS (SELECT item_id, unnest([text, '', CAST(item_id AS VARCHAR)]) AS text FROM benchmark) SELECT text, count(*) AS n FROM j GROUP BY text")
def json_solutions(spark, sf_dir):
    held = bench(spark, sf_dir).select(F.to_json(F.array("text", F.lit(""), F.col("item_id").cast("string"))).alias("solutions"))
    return decontam.solutions(held).groupBy("text").agg(F.count("*").alias("n"))


# Dedup.


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def exact_dedup(spark, sf_dir):
    return dedup.exact(docs(spark, sf_dir).select("doc_id", "text"), "text", "doc_id").select("doc_id")


_WS = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"WITH c AS (SELECT doc_id, {derived.CODE_SQL} AS content FROM documents) SELECT min(doc_id) AS doc_id FROM c GROUP BY regexp_replace(content, '{_WS}', '', 'g')")
def ws_key_dedup(spark, sf_dir):
    keyed = code(spark, sf_dir).select("doc_id", T.ws_key(F.col("content")).alias("key"))
    return dedup.exact(keyed, "key", "doc_id").select("doc_id")


@query("SELECT doc_id // 250 AS batch_id, sha1(text) AS sha1, max(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def sha1_batch_dedup(spark, sf_dir):
    return dedup.by_batch(docs(spark, sf_dir).select("doc_id", "text"), "text", "doc_id", "doc_id")


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[ \\n]+'), lambda w: w <> '')"
_SHINGLES = f"""sh AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents))"""
_SIGS = _SHINGLES + ", hs AS (SELECT doc_id, list_transform(s, lambda x: CAST('0x' || md5(x)[1:7] AS BIGINT)) AS h FROM sh WHERE len(s) > 0), sigs AS (SELECT doc_id, [" + ", ".join(f"list_min(list_transform(h, lambda x: (x * {a} + {b}) % {dedup.PRIME}))" for a, b in dedup.coefficients(32)) + "] AS sig FROM hs)"


@query(f"WITH {_SIGS} SELECT doc_id, array_to_string(sig, ',') AS sig FROM sigs")
def minhash_signatures(spark, sf_dir):
    s = dedup.signatures(docs(spark, sf_dir).select("doc_id", "text"), "text", "doc_id")
    return s.select("doc_id", F.array_join(F.transform("sig", lambda x: x.cast("string")), ",").alias("sig"))


@query(f"""WITH RECURSIVE {_SHINGLES}, e AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM sh),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.8),
    same AS (SELECT min(doc_id) OVER (PARTITION BY lower(text)) AS a, doc_id AS b FROM documents),
    edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT a, b FROM same UNION SELECT b, a FROM same),
    reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b)
    SELECT node AS doc_id, min(root) AS component FROM reach GROUP BY node""")
def near_dup_clusters(spark, sf_dir):
    return dedup.near(docs(spark, sf_dir).select("doc_id", "text"), "text", "doc_id")


@query(f"""WITH {_SIGS}, reps AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(text)),
    band AS (SELECT doc_id, k, array_to_string(sig[4 * k + 1:4 * k + 4], ',') AS v FROM sigs SEMI JOIN reps USING (doc_id), generate_series(0, 7) g(k)),
    low AS (SELECT k, v, min(doc_id) AS a FROM band GROUP BY k, v)
    SELECT DISTINCT a, doc_id AS b FROM band JOIN low USING (k, v) WHERE doc_id <> a""")
def lsh_pairs(spark, sf_dir):
    """Candidates of distinct texts: each band's least id with its other members."""
    _, once = dedup.distinct_texts(docs(spark, sf_dir).select("doc_id", "text"), "text", "doc_id")
    return dedup.candidates(dedup.banded(dedup.signatures(once, "text", "rep"), "rep", 8, 4))


_TRIPLES = f"""sh AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents SEMI JOIN reps USING (doc_id)))"""


@query(f"""WITH reps AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(text)), {_TRIPLES}, e AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM sh)
    SELECT a.doc_id AS a, b.doc_id AS b, round(count(*) / (a.n + b.n - count(*)), 6) AS similarity FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.5""")
def jaccard_pairs(spark, sf_dir):
    """Exact pairs of distinct texts at 0.5, by three-word shingles."""
    found = dedup.similar_pairs(docs(spark, sf_dir).select("doc_id", "text"), "text", "doc_id", 0.5, 3)
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH RECURSIVE {derived.RESPONSE_CTE},
    k AS (SELECT id, [regexp_replace(instruction, '{_WS}', '', 'g'), regexp_replace(response, '{_WS}', '', 'g')] AS keys, row_number() OVER (ORDER BY CAST('0x' || md5('0|' || id)[1:13] AS BIGINT), id) AS r FROM resp),
    g AS (SELECT 0::BIGINT AS r, []::VARCHAR[] AS seen, NULL::BIGINT AS id UNION ALL
          SELECT k.r, CASE WHEN list_has_any(g.seen, k.keys) THEN g.seen ELSE list_concat(g.seen, k.keys) END, CASE WHEN list_has_any(g.seen, k.keys) THEN NULL ELSE k.id END FROM g JOIN k ON k.r = g.r + 1)
    SELECT id FROM g WHERE id IS NOT NULL""")
def greedy_multi_key_dedup(spark, sf_dir):
    return stages.clean(responses(spark, sf_dir)).select("id")


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def seed_unique_check(spark, sf_dir):
    return dedup.assert_unique(docs(spark, sf_dir), "text")


# Positions.


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS pos FROM documents")
def sequential_ids(spark, sf_dir):
    return position.with_pos(docs(spark, sf_dir).select("source", "doc_id"), "source", "doc_id").select("doc_id", "pos")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) WHERE pos >= 50 AND pos < 150")
def slice_by_position(spark, sf_dir):
    return position.take(position.with_pos(docs(spark, sf_dir).select("doc_id"), "doc_id"), 50, 100).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def resume_retry(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id"), F.col("doc_id").alias("pos"))
    return position.resume(rows, rows.filter("doc_id % 3 = 0").withColumnRenamed("pos", "out_pos"), "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id > (SELECT max(doc_id) FROM documents WHERE doc_id <= 60 AND doc_id % 3 = 0)")
def resume_skip(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id"), F.col("doc_id").alias("pos"))
    done = rows.filter("doc_id % 3 = 0 AND doc_id <= 60").withColumnRenamed("pos", "out_pos")
    return position.resume(rows, done, "doc_id", legacy=True).select("doc_id")


@query("SELECT doc_id, doc_id // 250 AS chunk FROM documents")
def chunk_ids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", position.chunk(F.col("doc_id"), 250).alias("chunk"))


_DRAW = "CAST('0x' || md5('{seed}|' || doc_id)[1:13] AS BIGINT)"


@query(f"SELECT doc_id FROM documents ORDER BY {_DRAW.format(seed=42)}, doc_id LIMIT 25")
def seeded_sample(spark, sf_dir):
    return position.sample(docs(spark, sf_dir).select("doc_id"), 25, 42, "doc_id")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_DRAW.format(seed=3)}, doc_id) <= ceil(count(*) OVER () * 0.1) AS is_test FROM documents")
def train_test_split(spark, sf_dir):
    return position.split(docs(spark, sf_dir).select("doc_id"), 0.1, 3, "doc_id")


@query(f"SELECT doc_id, (['easy', 'medium', 'hard'])[1 + CAST('0x' || md5('7|' || doc_id || '|difficulty')[1:13] AS BIGINT) % 3] AS difficulty FROM documents")
def random_property(spark, sf_dir):
    p = prompts.random_property(F.array(F.lit("loops")), F.lit("Python"), 7, F.col("doc_id"))
    return docs(spark, sf_dir).select("doc_id", p["difficulty"].alias("difficulty"))


# Judge, completions, prompts.


@query("SELECT doc_id FROM (SELECT doc_id, lower(CASE WHEN toxic = 1 THEN 'No, no yes' WHEN quality = 1 THEN 'YES' WHEN doc_id % 2 = 0 THEN 'yes no' ELSE '' END) AS a FROM labels) WHERE len(a) - len(replace(a, 'yes', '')) > 1.5 * (len(a) - len(replace(a, 'no', '')))")
def yes_no_judge(spark, sf_dir):
    answer = F.expr("CASE WHEN toxic = 1 THEN 'No, no yes' WHEN quality = 1 THEN 'YES' WHEN doc_id % 2 = 0 THEN 'yes no' ELSE '' END")
    return table(spark, sf_dir, "labels").select("doc_id", answer.alias("answer")).filter(filters.judged_yes(F.col("answer"))).select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 2 END AS n FROM documents WHERE doc_id % 5 NOT IN (0, 4)")
def finish_reason_filter(spark, sf_dir):
    choice = lambda reason, text: F.struct(F.lit(reason).alias("finish_reason"), F.lit(text).alias("text"))
    choices = F.when(F.expr("doc_id % 5 = 0"), F.array().cast("array<struct<finish_reason:string,text:string>>")).when(F.expr("doc_id % 5 = 1"), F.array(choice("length", "a"), choice("stop", "b"))).when(F.expr("doc_id % 5 = 4"), F.array(choice("length", "c"))).otherwise(F.array(choice("eos_token", "d"), choice("stop", "e")))
    df = docs(spark, sf_dir).select("doc_id", choices.alias("choices")).withColumn("choices", filters.finished(F.col("choices")))
    return df.filter(F.size("choices") > 0).select("doc_id", F.size("choices").alias("n"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, ','), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), '|') AS concepts FROM documents")
def concept_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.concepts(F.col("text")), "|").alias("concepts"))


_TURNS = "SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS turns FROM conversations GROUP BY conv_id"


@query(f"SELECT conv_id, '{prompts.SYSTEM}' || chr(10) || chr(10) || array_to_string(list_transform(turns, lambda t: CASE WHEN t.role = 'user' THEN '### Instruction' || chr(10) || t.text || chr(10) || chr(10) ELSE '### Response' || chr(10) || t.text || '<|endoftext|>' || chr(10) || chr(10) END), '') || '### Response' || chr(10) AS prompt FROM ({_TURNS}) WHERE NOT list_contains(list_transform(turns, lambda t: t.role), 'system')")
def chat_template(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("conv_id", prompts.chat(F.col("turns")).alias("prompt")).filter("prompt is not null")


@query(R + f" SELECT id, '{prompts.SYSTEM}' || chr(10) || chr(10) || '### Instruction' || chr(10) || instruction || chr(10) || chr(10) || '### Response' || chr(10) || response AS prompt FROM resp")
def instruction_format(spark, sf_dir):
    return responses(spark, sf_dir).select("id", prompts.instruction_prompt(F.col("instruction"), F.col("response")).alias("prompt"))


#: A few-shot file; its first example has no solution.
_FEWSHOT_FILE = "### System: I->R\nRespond.\n\n### System: C->I\nInstruct.\n\n### System: S->C\nList concepts.\n\n" + "\n\n".join(
    f"### Example {k + 1}\n[Code]\nsnippet {k}\n\n[Property]\ncategory: c\nlanguage: Python\nconcepts: loops, sums\ndifficulty: easy\n\n[Instruction]\ninstruction {k}\n\n[Solution]\n{'solution' if k else ''}\n\n[Response]\nresponse {k}" for k in range(3))
_FEWSHOTS = prompts.parse_fewshots(_FEWSHOT_FILE)


@query("SELECT doc_id, 'List concepts.' || chr(10) || chr(10) || array_to_string(list_transform(list_sort([{'d': CAST('0x' || md5('5|' || doc_id || '|fewshots|' || i)[1:13] AS BIGINT), 'i': i} FOR i IN [0, 1, 2]])[1:2], lambda s, k: '## Example ' || k || chr(10) || '### Snippet' || chr(10) || 'snippet ' || s.i || chr(10) || chr(10) || '### Concepts' || chr(10) || 'loops, sums'), chr(10) || chr(10)) || chr(10) || chr(10) || '## Example 3' || chr(10) || '### Snippet' || chr(10) || source || chr(10) || chr(10) || '### Concepts' AS prompt FROM documents")
def fewshot_prompt(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", prompts.request_prompt(_FEWSHOTS, "S->C", 2, 5, F.col("source"), F.col("doc_id")).alias("prompt"))


@query("SELECT doc_id, '<fim_prefix>' || source || '<fim_suffix>' || coalesce(lang, '') || '<fim_middle>' AS prompt FROM documents")
def infill_prompt(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", prompts.infill("fim", F.col("source"), F.coalesce("lang", F.lit(""))).alias("prompt"))


@query("SELECT doc_id, substr(sha256('m' || doc_id || coalesce(lang, '')), 1, 5) AS fingerprint FROM documents")
def run_fingerprint(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.fingerprint(F.lit("m"), F.col("doc_id"), F.coalesce("lang", F.lit(""))).alias("fingerprint"))


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'C++' WHEN 1 THEN 'Java' WHEN 2 THEN 'PHP' WHEN 3 THEN 'Python' WHEN 4 THEN 'Rust' WHEN 5 THEN 'TypeScript' ELSE 'Python' END AS language FROM documents")
def language_lookup(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", joins.language_name(F.expr("element_at(array('cpp', 'java', 'php', 'python', 'rust', 'typescript', 'cobol'), CAST(doc_id % 7 AS INT) + 1)")).alias("language"))


# Responses.


_SECTIONS_OK = " AND ".join(f"(len(response) - len(replace(response, '{t}', ''))) = {len(t)}" for t in filters.TAGS) + " AND " + " AND ".join(f"strpos(response, '{a}') < strpos(response, '{b}')" for a, b in zip(filters.TAGS, filters.TAGS[1:], strict=False))


@query(R + f" SELECT id FROM resp WHERE {_SECTIONS_OK}")
def section_order_filter(spark, sf_dir):
    return responses(spark, sf_dir).filter(filters.sections_in_order(F.col("response"))).select("id")


_CUT = r"regexp_extract(response, '(?s)\[{a}\]\s*(.*?)\s*\[{b}\]', 1) AS {name}"


@query(R + f" SELECT id, {_CUT.format(a='Reasoning', b='Implementation', name='reasoning')}, {_CUT.format(a='Implementation', b='Explanation', name='implementation')}, {_CUT.format(a='Explanation', b='Tests', name='explanation')}, regexp_extract(response, '(?s)\\[Tests\\]\\s*(.*)$', 1) AS tests FROM resp WHERE {_SECTIONS_OK}")
def section_extract(spark, sf_dir):
    df = responses(spark, sf_dir).filter(filters.sections_in_order(F.col("response"))).withColumn("s", filters.sections(F.col("response")))
    return df.select("id", "s.*")


@query(R + r" SELECT id, array_to_string(list_transform(regexp_extract_all(response, '(?s)```(?:[A-Za-z]+\n)?(.*?)```', 1), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), '|') AS blocks FROM resp")
def fenced_blocks(spark, sf_dir):
    return responses(spark, sf_dir).select("id", F.array_join(T.fenced_blocks(F.col("response")), "|").alias("blocks"))


@query(R + r" SELECT id, CAST(len(b) AS INT) AS n, array_to_string(b, '|') AS code FROM (SELECT id, list_filter(regexp_extract_all(response, '(?ms)^```python[ ]*\n(.*?)^```', 1), lambda x: NOT contains(x, '/ note')) AS b FROM resp)")
def exec_code(spark, sf_dir):
    found = responses(spark, sf_dir).select("id", syntax.compilable(T.exec_blocks(F.col("response"))).alias("b"))
    return found.select("id", F.size("b").alias("n"), F.array_join("b", "|").alias("code"))


@query(R + " SELECT id FROM resp WHERE NOT regexp_matches(lower(response), 'todo|fixme|write your code here|your code here|your code goes here|notimplemented')")
def incomplete_filter(spark, sf_dir):
    return responses(spark, sf_dir).filter(filters.is_complete(F.col("response"))).select("id")


_NO_COMMENTS = R + " SELECT id, replace(replace(replace(response, '# add' || chr(10), ''), '    # one' || chr(10), ''), '# Your code here' || chr(10), '') AS response FROM resp"


@query(_NO_COMMENTS)
def comment_removal(spark, sf_dir):
    return responses(spark, sf_dir).select("id", T.without_comments(F.col("response")).alias("response"))


@query(_NO_COMMENTS)
def comment_removal_rows(spark, sf_dir):
    """comment_removal under its earlier name."""
    return comment_removal(spark, sf_dir)


@query(R + " SELECT id, split_part(response, '```', 1) AS head FROM resp")
def completion_truncate(spark, sf_dir):
    return responses(spark, sf_dir).select("id", T.cut_at(F.col("response"), T.FENCE).alias("head"))


#: Sections of the responses that the sanitizer keeps, by variant: reasoning, implementation, explanation, tests.
_GOOD = ("Think {id}.", "{f}python\n# add\ndef f(x):\n    # one\n    return x + {id}\n{f}", "It adds {id}.")
_KEPT = {
    0: (*_GOOD, "{f}python\nassert f(1) == {id}\nassert f(2) == 3\n{f}"),
    1: (*_GOOD, "{f}python\ndef test_f():\n    assert f(1)\ntest_f()\n{f}"),
    6: ("Think.", "{f}python\n# Your code here\n{f}", "None {id}.", "{f}python\nassert True\n{f}"),
    10: (*_GOOD, "{f}python\nassert f(3)\n{f}"),
    12: (*_GOOD, "{f}python\nassert f(4)"),
}
_COMPLETE = [0, 1, 10, 12]


def _kept(*sections: int, tags: bool = False, comments: bool = True, variants=tuple(_KEPT)) -> str:
    """SQL for the responses that are left with these sections."""
    named = lambda k, t: f"{filters.TAGS[k]}\n{t}" if tags else t
    clean = lambda t: t if comments else t.replace("# add\n", "").replace("    # one\n", "")
    return derived.case({v: "\n\n".join(named(k, clean(_KEPT[v][k])) for k in sections) for v in variants}, "id", 13)


@query(R + f" SELECT id, {_kept(0, 1, 2, 3, tags=True)} AS response FROM resp WHERE id % 13 IN (0, 1, 6, 10, 12)")
def sanitize_raw(spark, sf_dir):
    return sanitize.sanitize(responses(spark, sf_dir), sanitize.Flags(raw=True)).select("id", "response")


@query(R + f" SELECT id, instruction, {_kept(0, 1, 2, comments=False, variants=_COMPLETE)} AS response FROM resp WHERE id % 13 IN (0, 1, 10, 12)")
def sanitize_no_tests(spark, sf_dir):
    return sanitize.sanitize(responses(spark, sf_dir), sanitize.Flags(no_tests=True, no_comments=True, no_incomplete=True))


@query(R + " " + " UNION ALL ".join(f"SELECT '{name}' AS flag, id, {sql} AS response FROM resp WHERE id % 13 IN (0, 1, 6, 10, 12)" for name, sql in (("none", _kept(0, 1, 2, 3)), ("no_explanation", _kept(0, 1, 3)), ("no_reasoning", _kept(1, 2, 3)), ("code_only", _kept(0, 1, 2, 3)))))
def sanitize_flags(spark, sf_dir):
    """Each section flag by itself; in these responses the implementation is its one block, so code_only changes nothing."""
    rows = responses(spark, sf_dir)
    flags = {"none": {}, "no_explanation": {"no_explanation": True}, "no_reasoning": {"no_reasoning": True}, "code_only": {"code_only": True}}
    parts = [sanitize.sanitize(rows, sanitize.Flags(**f)).select(F.lit(name).alias("flag"), "id", "response") for name, f in flags.items()]
    return reduce(DataFrame.unionByName, parts)


def _draw_sql(what: str) -> str:
    return f"CAST('0x' || md5('0|' || id || '|{what}')[1:13] AS BIGINT)"


#: What augmentation adds to each kept row's instruction: chosen assertion lines, or the whole block.
_ASSERTIONS = R + f""", t AS (SELECT id, instruction, CASE id % 13 WHEN 0 THEN ['assert f(1) == ' || id, 'assert f(2) == 3'] WHEN 6 THEN ['assert True'] WHEN 10 THEN ['assert f(3)'] END AS l FROM resp WHERE id % 13 IN (0, 1, 6, 10, 12)),
    k AS (SELECT *, least({_draw_sql('k')} % 5 + 1, len(l)) AS k FROM t),
    c AS (SELECT *, list_sort(list_transform(generate_series(1, len(l)), lambda i: {{'d': CAST('0x' || md5('0|' || id || '|lines|' || (i - 1))[1:13] AS BIGINT), 'i': i, 'x': l[i]}}))[1:k] AS chosen FROM k),
    a AS (SELECT id, instruction, chr(10) || chr(10) || 'Your code should pass the following ' || CASE WHEN l IS NULL THEN 'test case' WHEN k > 1 THEN 'assertions' ELSE 'assertion' END || ':' || chr(10) || '```python' || chr(10)
    || CASE WHEN id % 13 = 1 THEN 'def test_f():' || chr(10) || '    assert f(1)' || chr(10) || 'test_f()' WHEN id % 13 = 12 THEN 'assert f(4)' || chr(10) || '/ note' ELSE array_to_string(list_transform(chosen, lambda s: s.x), chr(10)) END || chr(10) || '```' AS more FROM c)"""


@query(_ASSERTIONS + " SELECT id, instruction || more AS instruction FROM a")
def assertion_augment(spark, sf_dir):
    """Every row that the sanitizer keeps, with one to five assertion lines or the whole block."""
    return sanitize.sanitize(responses(spark, sf_dir), sanitize.Flags(no_tests=True, augmentation=1.0)).select("id", "instruction")


@query(_ASSERTIONS + " SELECT id, instruction || more AS instruction FROM a")
def assertion_augment_rows(spark, sf_dir):
    """assertion_augment under its earlier name."""
    return assertion_augment(spark, sf_dir)


_HALF = str(1 << 51)
_SMART = [(f"{e} AND {r} AND {t}", _kept(*sections, comments=False, variants=_COMPLETE)) for e, r, t, sections in (
    (e, r, t, [k for k, keep in enumerate(("NOT" in r, True, "NOT" in e, t == "asks")) if keep])
    for e in ("de", "NOT de") for r in ("dr", "NOT dr") for t in ("asks", "NOT asks"))]


@query(_ASSERTIONS + f""", s AS (SELECT *, contains(lower(instruction), 'test') AS asks, {_draw_sql('explanation')} < {_HALF} AS de, {_draw_sql('reasoning')} < {_HALF} AS dr, {_draw_sql('augment')} < {_HALF} AS au FROM a WHERE id % 13 <> 6)
    SELECT id, CASE WHEN au AND NOT asks THEN instruction || more ELSE instruction END AS instruction, CASE {' '.join(f'WHEN {c} THEN {x}' for c, x in _SMART)} END AS response FROM s""")
def sanitize_smart(spark, sf_dir):
    """Sections, comments and augmentation as the row decides."""
    return sanitize.sanitize(responses(spark, sf_dir), sanitize.Flags(smart=True))


@query(C + " SELECT doc_id, EXISTS (SELECT 1 FROM code b WHERE b.doc_id % 5 = 0 AND b.content = a.content) AS cached FROM code a")
def cached_split(spark, sf_dir):
    rows = code(spark, sf_dir)
    cached, active = joins.split_cached(rows, rows.filter("doc_id % 5 = 0"), "content")
    return cached.select("doc_id", F.lit(True).alias("cached")).unionByName(active.select("doc_id", F.lit(False).alias("cached")))


@query(C + " SELECT doc_id FROM code WHERE doc_id % 12 <> 9")
def type_check_filter(spark, sf_dir):
    from .backends.services import Checker

    rows = code(spark, sf_dir).withColumn("sha1", F.sha1("content"))
    return joins.with_verdicts(rows, Checker().apply(rows.dropDuplicates(["sha1"]))).select("doc_id")


@query("WITH t AS (SELECT {'a': doc_id, 'b': CASE WHEN doc_id % 2 = 0 THEN 1 END} AS r FROM documents) SELECT unnest(['a', 'b']) AS key, count(*) AS n FROM t GROUP BY 1")
def common_keys(spark, sf_dir):
    d = docs(spark, sf_dir)
    lines = d.select(F.expr("CASE WHEN doc_id % 2 = 0 THEN '{\"a\": 1, \"b\": 1}' WHEN doc_id % 3 = 0 THEN '{\"a\": 1, \"b\": null, \"c\": 2}' ELSE '{\"a\": 1, \"b\": null}' END").alias("value"))
    keys = joins.common_keys(lines)
    return d.select(F.explode(F.array(*map(F.lit, keys))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


# Evaluation and training.


@query("SELECT item_id, CAST(s AS BIGINT) AS sample_idx FROM benchmark, generate_series(0, 3) g(s)")
def eval_samples(spark, sf_dir):
    return joins.samples(bench(spark, sf_dir).select("item_id"), 4)


@query("SELECT item_id, CAST(s AS BIGINT) AS batch FROM benchmark, generate_series(0, 2) g(s)")
def eval_cross(spark, sf_dir):
    return joins.batched(bench(spark, sf_dir).select("item_id"), 3)


@query("SELECT item_id, 'Write a Python function to solve the given task:' || chr(10) || '```python' || chr(10) || trim(text) || chr(10) || '```' AS instruction FROM benchmark")
def humaneval_prompt(spark, sf_dir):
    return bench(spark, sf_dir).select("item_id", stages.humaneval_problem(F.col("text"), F.col("item_id"))["instruction"].alias("instruction"))


@query("SELECT item_id, trim(text) || '.' || chr(10) || chr(10) || 'Your code should pass the following assertion:' || chr(10) || '```python' || chr(10) || 'assert f(' || item_id || ')' || chr(10) || '```' AS instruction FROM (SELECT item_id, rtrim(text, '.') AS text FROM benchmark)")
def mbpp_prompt(spark, sf_dir):
    prompt = F.concat(F.lit('"""'), F.rtrim(F.col("text"), F.lit(".")), F.lit(" assert f("), F.col("item_id").cast("string"), F.lit(')"""'))
    return bench(spark, sf_dir).select("item_id", stages.mbpp_problem(prompt, F.col("item_id"))["instruction"].alias("instruction"))


@query("SELECT quality, round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, count(*) AS n FROM labels GROUP BY quality")
def pass_rate(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality").agg(F.round(F.avg(F.when(F.col("toxic") == 0, 1.0).otherwise(0.0)), 6).alias("pass_rate"), F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN c > 7 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE round(1 - list_product([1 - 3.0 / i FOR i IN generate_series(10 - c + 1, 10)]), 6) END AS p FROM (SELECT doc_id, doc_id % 11 AS c FROM documents)")
def pass_at_k(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", F.lit(10).cast("long").alias("n"), (F.col("doc_id") % 11).alias("c"))
    return df.select("doc_id", F.round(stages.pass_at_k("n", "c", 3), 6).alias("p"))


_IDS = "list_transform(list_filter(regexp_split_to_array({c}, '[ \\n]+'), lambda w: w <> ''), lambda w: CAST('0x' || md5(w)[1:7] AS BIGINT) % 32000 + 3)"
_SFT = f"e AS (SELECT id, list_concat([1], {_IDS.format(c='instruction')}) AS p, list_concat({_IDS.format(c='response')}, [2]) AS r FROM resp)"


@query(R + f", {_SFT} SELECT id, array_to_string(list_concat(p, r)[1:20], ',') AS input_ids, array_to_string(list_concat(list_transform(p, lambda x: -100), r)[1:20], ',') AS labels, len(p) + len(r) > 20 AS exceeding_length FROM e")
def sft_map(spark, sf_dir):
    e = K.supervised(K.word_ids(F.col("instruction")), K.word_ids(F.col("response")), 20)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return responses(spark, sf_dir).select("id", e.alias("e")).select("id", joined(F.col("e.input_ids")).alias("input_ids"), joined(F.col("e.labels")).alias("labels"), "e.exceeding_length")


@query(R + f", {_SFT}, x AS (SELECT id, id // 8 AS b, list_concat(p, r)[1:20] AS i FROM e) SELECT id, CAST(max(len(i)) OVER (PARTITION BY b) AS BIGINT) AS padded, CAST(len(i) AS BIGINT) AS on_places FROM x")
def collate_pad(spark, sf_dir):
    e = K.supervised(K.word_ids(F.col("instruction")), K.word_ids(F.col("response")), 20)
    df = K.collate(responses(spark, sf_dir).select("id", F.floor(F.col("id") / 8).alias("b"), e.alias("e")).select("id", "b", "e.input_ids", "e.labels"), "b", 0)
    return df.select("id", F.size("input_ids").cast("long").alias("padded"), F.size(F.filter("attention_mask", lambda m: m)).cast("long").alias("on_places"))


@query("SELECT count(*) AS rows_in, count(*) FILTER (doc_id % 12 = 9) AS uncompilable, round(avg(CASE WHEN doc_id % 12 = 9 THEN 0.0 ELSE 1.0 END), 6) AS ratio FROM documents")
def stage_counters(spark, sf_dir):
    f = code(spark, sf_dir).select(syntax.code_features(F.col("content")).alias("f")).select((~F.col("f.parses")).cast("int").alias("bad"))
    return f.agg(F.count("*").alias("rows_in"), F.sum("bad").alias("uncompilable"), F.round(F.avg(1.0 - F.col("bad")), 6).alias("ratio"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n, CAST(strpos(text, 'th') - 1 AS BIGINT) AS first, CAST((length(text) - length(replace(text, 'th', ''))) // 2 AS BIGINT) AS times FROM documents")
def substring_functions(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.length(t).cast("long").alias("n"), T.index(t, "th").alias("first"), T.count_of(t, "th").alias("times"))


#: What is left of each variant of derived.CODE without its first docstring; None where it has none in double quotes.
_UNDOCUMENTED = (
    "def plus_{id}(x):\n    \n    y = x + {id}\n    return y",
    "def none_{id}():\n    \n    return {id}",
    "def quiet_{id}(x):\n    \n    print(x)\n    return",
    None,
    None,
    "def later_{id}(x):\n    \n    # TODO later\n    return x",
    "import os\n\ndef paths_{id}(x):\n    \n    return os.path.join(x, x)",
    "def trace_{id}(x):\n    \n    debugger = x\n    return debugger",
    "def long_{id}(x):\n    \n{many}    return x",
    None,
    "def same(x):\n    \n    return x{pad}",
    f"@cache\ndef outer_{{id}}(x):\n    \n    def inner(y):\n        return y\n    return inner(x)\n\nasync def second_{{id}}(x):\n    {derived.Q3}More.{derived.Q3}\n    return x",
)


@query("SELECT doc_id, CASE WHEN doc_id % 12 = 0 THEN 'Return x plus ' || doc_id || '.' || chr(10) || chr(10) || '    Any number.' WHEN doc_id % 12 IN (1, 2, 5, 6, 7, 8, 11) THEN 'Doc ' || doc_id || '.' WHEN doc_id % 12 = 10 THEN 'Doc.' END AS doc, CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN {derived._sql(t, 'doc_id')}" for k, t in enumerate(_UNDOCUMENTED) if t) + " END AS code FROM documents")
def docstring_split_rows(spark, sf_dir):
    """Every row's first docstring and the code that is left."""
    return code(spark, sf_dir).select("doc_id", T.split_docstring(F.col("content")).alias("s")).select("doc_id", "s.doc", "s.code")


@query(ORACLES["docstring_split_rows"])
def docstring_split(spark, sf_dir):
    return docstring_split_rows(spark, sf_dir)


@query("SELECT doc_id, 'Python' AS language, 'easy' AS difficulty, 'c1|' || doc_id AS concepts FROM documents")
def property_round_trip(spark, sf_dir):
    p = T.properties(F.concat(F.lit("category: x\nlanguage: Python\nconcepts: c1, "), F.col("doc_id").cast("string"), F.lit("\ndifficulty: easy")))
    again = T.properties(T.render_properties(p))
    return docs(spark, sf_dir).select("doc_id", again["language"].alias("language"), again["difficulty"].alias("difficulty"), F.array_join(again["concepts"], "|").alias("concepts"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_window_counts(spark, sf_dir):
    return resumable.event_counts(table(spark, sf_dir, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# Operators of the judge, evaluation and training stages.


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Python' END AS language, CASE WHEN doc_id % 4 = 0 THEN 'a|' || doc_id END AS concepts FROM documents")
def property_json(spark, sf_dir):
    """Properties through JSON and back; numbers for texts and a text for the list are refused."""
    d = docs(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("i"))
    good = F.struct(F.lit("c").alias("category"), F.lit("Python").alias("language"), F.array(F.lit("a"), F.col("i")).alias("concepts"), F.lit("easy").alias("difficulty"))
    texts = F.when(F.expr("doc_id % 4 = 0"), T.property_json(good)).when(F.expr("doc_id % 4 = 1"), F.lit('{"category": "c", "language": 1, "concepts": ["a"], "difficulty": "easy"}')).when(F.expr("doc_id % 4 = 2"), F.lit('{"category": "c", "language": "Python", "concepts": "a", "difficulty": "easy"}')).otherwise("not json")
    p = d.select("doc_id", T.property_from_json(texts).alias("p"))
    return p.select("doc_id", F.col("p.language").alias("language"), F.array_join("p.concepts", "|").alias("concepts"))


@query(R + " SELECT id, '[R] ' || rtrim(split_part(replace(response, '[Tests]', '### x'), '###', 1), ' ' || chr(10)) AS response FROM resp")
def chat_response(spark, sf_dir):
    df = responses(spark, sf_dir)
    output = F.concat("instruction", F.replace("response", F.lit("[Tests]"), F.lit("### x")))
    return df.select("id", T.chat_response(output, F.col("instruction"), F.lit("[R] ")).alias("response"))


@query(R + " SELECT id // 8 AS batch, bool_and(contains(response, '[Tests]') OR contains(response, 'words')) AS stop FROM resp GROUP BY 1")
def stop_criteria(spark, sf_dir):
    """Whether all generations of a batch hold a stop string."""
    df = responses(spark, sf_dir).select(F.floor(F.col("id") / 8).cast("long").alias("batch"), T.stopped(F.col("response"), "[Tests]", "words").alias("s"))
    return df.groupBy("batch").agg(F.every("s").alias("stop"))


@query("SELECT name, text, count(*) AS n FROM (SELECT 'mbpp_docstrings' AS name, text FROM benchmark UNION ALL SELECT 'mbpp_solutions', 'return x + ' || item_id FROM benchmark UNION ALL SELECT 'human_eval_docstrings', trim(text) FROM benchmark WHERE item_id % 3 < 2 UNION ALL SELECT 'human_eval_solutions', 'return ' || item_id FROM benchmark WHERE item_id % 4 <> 0) GROUP BY 1, 2")
def benchmark_registry(spark, sf_dir):
    """The four named sets; prompts without a docstring and solutions that are too generic drop out."""
    b = bench(spark, sf_dir)
    item = F.col("item_id").cast("string")
    mbpp = b.select(F.col("text").alias("prompt"), F.concat(F.lit("return x + "), item).alias("code"))
    quoted = F.when(F.expr("item_id % 3 = 0"), F.concat(F.lit('def f():\n    """'), "text", F.lit('"""'))).when(F.expr("item_id % 3 = 1"), F.concat(F.lit("def f():\n    '''"), "text", F.lit("'''"))).otherwise("def f()")
    humaneval = b.select(quoted.alias("prompt"), F.when(F.expr("item_id % 4 = 0"), F.lit("    return x + y\n")).otherwise(F.concat(F.lit("    return "), item)).alias("canonical_solution"))
    return decontam.standard_sets(mbpp, humaneval).groupBy("name", "text").agg(F.count("*").alias("n"))


@query("SELECT source || '-' || lang || v AS name, CAST(count(*) AS BIGINT) AS n FROM benchmark, (SELECT unnest(['cpp', 'cs', 'd', 'go', 'java', 'jl', 'js', 'lua', 'php', 'pl', 'py', 'r', 'rb', 'rkt', 'rs', 'scala', 'sh', 'swift', 'ts']) AS lang) l, (VALUES ('humaneval', ''), ('humaneval', '-remove'), ('mbpp', '')) s(source, v) GROUP BY 1")
def multi_language_sets(spark, sf_dir):
    b = bench(spark, sf_dir).select(F.col("text").alias("prompt"))
    return decontam.counts(decontam.multi_language(lambda name: b))


@query(R + f", {_SFT} SELECT CAST(sum(CASE WHEN len(p) + len(r) > 20 THEN 1 ELSE 0 END) AS BIGINT) AS truncated, count(*) AS n FROM e")
def truncated_sum(spark, sf_dir):
    e = K.supervised(K.word_ids(F.col("instruction")), K.word_ids(F.col("response")), 20)
    return K.truncated(responses(spark, sf_dir).select(e.alias("e")).select("e.*"))


@query(R + f", {_SFT}, x AS (SELECT id, id // 8 AS b, list_concat(p, r)[1:20] AS i FROM e) SELECT id, array_to_string(list_concat(i, list_transform(generate_series(1, m - len(i)), lambda k: 0)), ',') AS input_ids, m AS on_places FROM (SELECT id, i, CAST(max(len(i)) OVER (PARTITION BY b) AS BIGINT) AS m FROM x)")
def collate_all_ones(spark, sf_dir):
    """The mask of the family that attends to padding."""
    e = K.supervised(K.word_ids(F.col("instruction")), K.word_ids(F.col("response")), 20)
    df = K.collate(responses(spark, sf_dir).select("id", F.floor(F.col("id") / 8).alias("b"), e.alias("e")).select("id", "b", "e.input_ids", "e.labels"), "b", 0, all_ones=True)
    return df.select("id", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",").alias("input_ids"), F.size(F.filter("attention_mask", lambda m: m)).cast("long").alias("on_places"))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_DRAW.format(seed=3)}, doc_id) <= 37 AS is_test FROM documents")
def train_test_split_count(spark, sf_dir):
    return position.split(docs(spark, sf_dir).select("doc_id"), 37, 3, "doc_id")


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS family, '{a}' || source || '{b}' || coalesce(lang, '') || '{c}' AS prompt FROM documents" for k, (a, b, c) in prompts.INFILL.items()))
def infill_families(spark, sf_dir):
    d = docs(spark, sf_dir)
    return reduce(DataFrame.unionByName, [d.select("doc_id", F.lit(k).alias("family"), prompts.infill(k, F.col("source"), F.coalesce("lang", F.lit(""))).alias("prompt")) for k in prompts.INFILL])


#: Judge examples, and the question around a docstring and code.
_JUDGED = (("Adds.", "def add(x):\n    return x + 1", "Yes"), ("Does it.", "def go(x):\n    return x", "No"))


def _ask_sql(doc: str, code: str) -> str:
    return f"'Docstring:' || chr(10) || {doc} || chr(10) || chr(10) || 'Code:' || chr(10) || {code} || chr(10) || chr(10) || 'Does the docstring describe the code fully? Answer yes or no.' || chr(10) || 'Answer:'"


#: Letters of a judge prompt beside the judged text.
_JUDGE_ROOM = sum(len(d) + len(c) + len(a) + 1 for d, c, a in _JUDGED) + 3 * 91 + 4 - 6
_SHOWN = [_ask_sql(derived._sql(d, "doc_id"), derived._sql(c, "doc_id")) + f" || ' {a}'" for d, c, a in _JUDGED]
#: The operator's measure of what stands around a text: the dummy's prompt (an empty docstring, and the code without it) less the dummy.
_DUMMY_ASKED = f"{_SHOWN[0]} || chr(10) || chr(10) || {_SHOWN[1]} || chr(10) || chr(10) || {_ask_sql(repr(''), derived._sql(re.sub(f'{derived.Q3}.*{derived.Q3}', '', prompts.DUMMY, flags=re.S), 'doc_id'))}"


def _fits_sql(most: int) -> str:
    return f"length(content) + length({_DUMMY_ASKED}) - {len(prompts.DUMMY)} <= {most}"



@query(f"""WITH d AS ({ORACLES['docstring_split_rows']}), c AS (SELECT doc_id, {derived.CODE_SQL} AS content FROM documents),
    p AS (SELECT doc_id, content, CASE WHEN CAST('0x' || md5('5|' || doc_id || '|judge|0')[1:13] AS BIGINT) < CAST('0x' || md5('5|' || doc_id || '|judge|1')[1:13] AS BIGINT) THEN {_SHOWN[0]} || chr(10) || chr(10) || {_SHOWN[1]} ELSE {_SHOWN[1]} || chr(10) || chr(10) || {_SHOWN[0]} END
          || chr(10) || chr(10) || {_ask_sql('doc', 'code')} AS prompt FROM d JOIN c USING (doc_id))
    SELECT doc_id FROM p WHERE md5(prompt)[1:1] < '8' AND {_fits_sql(_JUDGE_ROOM + 299)}""")
def judge_stage(spark, sf_dir):
    """Rows that the stand-in judge says yes to; a text's letters stand for its tokens here."""
    from .backends.services import Batched

    return stages.judged(code(spark, sf_dir), list(_JUDGED), Batched(), F.length, _JUDGE_ROOM + 299, 5, "content", "doc_id").select("doc_id")


@query(C + " SELECT doc_id, CASE WHEN doc_id % 12 = 6 THEN content ELSE 'import math' || chr(10) || chr(10) || content END AS content FROM (SELECT doc_id, CASE WHEN doc_id % 12 = 6 THEN content ELSE 'x = math.pi' END AS content FROM code)")
def import_fixes(spark, sf_dir):
    from .backends.services import ImportFixer

    rows = code(spark, sf_dir).withColumn("content", F.when(F.expr("doc_id % 12 = 6"), F.col("content")).otherwise("x = math.pi"))
    return ImportFixer().apply(rows)


# Places and scopes of code: extraction by offsets, type checks, imports.


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.modules(docs(spark, sf_dir))


def _def(name: str, doc: str, body: str, end: str = "\n", arg: str = "x") -> str:
    return f"def {name}_{{id}}({arg}):{end}    {derived.Q3}{doc}{derived.Q3}{end}    return {body}"


#: The documented functions of derived.MODULES: (variant, position) -> (name, text).
_PLACED = {
    (0, 0): ("area_{id}", _def("area", "Area.", "math.pi * r", arg="r")),
    (5, 0): ("root_{id}", _def("root", "Root.", "math.sqrt(x)")),
    (6, 0): ("feed_{id}", _def("feed", "Feed.", "x")),
    (6, 1): ("next_{id}", _def("next", "Next.", "x")),
    (7, 0): ("crlf_{id}", _def("crlf", "Doc.", "os.sep + x", "\r\n")),
    (8, 0): ("wide_{id}", _def("wide", "Doc é\x0b{id}.", "LINE + x")),
    (9, 0): ("cr_{id}", _def("cr", "Doc.", "x", "\r")),
    (9, 1): ("cs_{id}", _def("cs", "Doc.", "cr_{id}(x, x)", "\r")),
}


@query(M + ", f AS (" + " UNION ALL ".join(f"SELECT doc_id, content, {p} AS position, {derived._sql(name, 'doc_id')} AS name, {derived._sql(text, 'doc_id')} AS f FROM modules WHERE doc_id % 14 = {v}" for (v, p), (name, text) in _PLACED.items()) + ") SELECT doc_id, position, name, strlen(split_part(content, f, 1)) AS first_byte, strlen(split_part(content, f, 1)) + strlen(f) AS last_byte, f AS content FROM f")
def extract_offsets(spark, sf_dir):
    """Every documented function with its place, by a table function; line ends of all kinds, form feeds and separators."""
    return syntax.functions_of(modules(spark, sf_dir))


@query("SELECT doc_id, CAST(([0, 0, 1, 1, 1, 1, 0, 0, 0, 1, 2, 1, 0, 0])[1 + doc_id % 14] AS BIGINT) AS errors FROM documents")
def type_errors(spark, sf_dir):
    """Errors of every module by a checker program: unbound names and misfit calls of code that parses."""
    from .backends.services import ProcessChecker

    rows = modules(spark, sf_dir).withColumn("sha1", F.sha1("content"))
    return rows.join(ProcessChecker().apply(spread(rows.dropDuplicates(["sha1"]), "sha1")), "sha1").select("doc_id", "errors")


#: derived.MODULES once imports are inferred.
_IMPORTED = dict(enumerate(derived.MODULES)) | {
    4: "from collections import Counter\n\n" + derived.MODULES[4],
    5: "import math\n\n" + derived.MODULES[5],
    10: derived.MODULES[10].replace("annotations\n", "annotations\nfrom collections import Counter\nimport math\n"),
}


@query(f"SELECT doc_id, {derived.case(_IMPORTED, n=14)} AS content FROM documents")
def import_inference(spark, sf_dir):
    """Modules with the imports that an index of all modules knows for their unbound names."""
    rows = modules(spark, sf_dir)
    return imports.add(rows, imports.learn(rows))


@query("""WITH n AS (SELECT doc_id % 14 AS v, count(*) AS n FROM documents WHERE doc_id % 5 = 0 GROUP BY 1),
    s AS (SELECT unnest(['import math', 'import os', 'from collections import deque', 'from collections import Counter', 'from collections import Counter', 'from collections import Counter', 'from typing import Counter']) AS statement,
                 unnest([0, 7, 13, 1, 13, 12, 12]) AS v, unnest([1, 1, 1, 1, 1, 0, 1]) AS there, unnest([1, 1, 1, 1, 1, 1, 0]) AS inferred)
    SELECT statement, CAST(sum(n * there) AS BIGINT) AS there, CAST(sum(n * inferred) AS BIGINT) AS inferred, CAST(sum(n * there * inferred) AS BIGINT) AS "right" FROM s JOIN n USING (v) GROUP BY statement""")
def import_precision(spark, sf_dir):
    """What an index of four fifths of the modules recovers of the other fifth's imports."""
    rows = modules(spark, sf_dir)
    return imports.precision(rows.filter("doc_id % 5 = 0"), imports.learn(rows.filter("doc_id % 5 <> 0")))


@query("SELECT doc_id FROM documents WHERE doc_id % 14 NOT IN (2, 3, 9, 11)")
def typed_functions(spark, sf_dir):
    """Modules that return a value and type-check once inferred imports are added."""
    rows = modules(spark, sf_dir)
    return stages.typed(rows, index=imports.learn(rows)).select("doc_id")


# Cleaning by names, and counters of a run.


_NAMED = "CASE WHEN id % 11 = 0 THEN 'No block ' || id WHEN id % 11 = 1 THEN replace({r}, '```python', '```') ELSE {r} END"
_RENAMED = "replace(response, 'def f(', 'def f_' || CAST(id % 23 AS STRING) || '(')"


@query(f"""WITH RECURSIVE {derived.RESPONSE_CTE}, n AS (SELECT id, instruction, {_NAMED.format(r=_RENAMED)} AS response, CASE WHEN id % 13 IN (4, 6, 7, 9) THEN '' ELSE 'f_' || id % 23 END AS names FROM resp),
    k AS (SELECT id, [regexp_replace(instruction, '{_WS}', '', 'g'), regexp_replace(response, '{_WS}', '', 'g'), names] AS keys, row_number() OVER (ORDER BY CAST('0x' || md5('0|' || id)[1:13] AS BIGINT), id) AS r FROM n WHERE id % 11 <> 0),
    g AS (SELECT 0::BIGINT AS r, []::VARCHAR[] AS seen, NULL::BIGINT AS id UNION ALL
          SELECT k.r, CASE WHEN list_has_any(g.seen, k.keys) THEN g.seen ELSE list_concat(g.seen, k.keys) END, CASE WHEN list_has_any(g.seen, k.keys) THEN NULL ELSE k.id END FROM g JOIN k ON k.r = g.r + 1)
    SELECT id FROM g WHERE id IS NOT NULL""")
def clean_by_names(spark, sf_dir):
    """Greedy dedup that also tells responses apart by the function names of their first block, whatever its tag; those without a block go."""
    rows = responses(spark, sf_dir)
    return stages.clean(rows.withColumn("response", F.expr(_NAMED.format(r=_RENAMED))), by_names=True).select("id")


def _answers(prompt, seed, sampling):
    """A model that fails for some seeds and is cut off for others."""
    if seed % 7 == 0:
        raise ValueError("no answer")
    return [("length" if seed % 5 == 0 else "stop", "loops, sums")]


@query(R + r""", x AS (SELECT id, array_to_string(list_filter(regexp_extract_all(response, '(?ms)^```python[ ]*\n(.*?)^```', 1), lambda x: NOT contains(x, '/ note')), chr(10)) AS code FROM resp),
    t AS (SELECT *, code IN (SELECT code FROM x WHERE id % 5 = 0) AS cached FROM x WHERE code <> ''),
    s AS (SELECT id % 13 AS v FROM resp), g AS (SELECT id + 3 AS seed FROM resp)
    SELECT 'execute' AS stage, 'uncompilable' AS reason, (SELECT count(*) FROM x) AS rows_in, (SELECT count(*) FROM x WHERE code = '') AS n
    UNION ALL SELECT 'execute', 'cached', count(*), count(*) FILTER (cached) FROM t UNION ALL SELECT 'execute', 'active', count(*), count(*) FILTER (NOT cached) FROM t
    UNION ALL SELECT 'execute', 'failed', count(*), count(*) FILTER (contains(code, 'f(3)')) FROM t WHERE NOT cached
    UNION ALL SELECT 'sanitize', 'sections', count(*), count(*) FILTER (v IN (4, 5, 7)) FROM s UNION ALL SELECT 'sanitize', 'blocks', count(*), count(*) FILTER (v IN (3, 8, 9)) FROM s WHERE v NOT IN (4, 5, 7)
    UNION ALL SELECT 'sanitize', 'tests', count(*), count(*) FILTER (v IN (2, 11)) FROM s WHERE v IN (0, 1, 2, 6, 10, 11, 12) UNION ALL SELECT 'sanitize', 'incomplete', count(*), count(*) FILTER (v = 6) FROM s WHERE v IN (0, 1, 6, 10, 12)
    UNION ALL SELECT 'generate', 'error', count(*), count(*) FILTER (seed % 7 = 0) FROM g UNION ALL SELECT 'generate', 'unfinished', count(*), count(*) FILTER (seed % 5 = 0) FROM g WHERE seed % 7 <> 0""")
def observed_counters(spark, sf_dir):
    """What execution, sanitizing and generation drop and why, counted in the runs that write their rows."""
    from .backends.services import Completions, Executor, Retry

    rows, report = responses(spark, sf_dir), Report()
    saved(stages.execution_filter(rows, Executor(run=lambda code: "f(3)" not in code, at_once=1), rows.filter("id % 5 = 0"), report))
    saved(sanitize.sanitize(rows, sanitize.Flags(no_tests=True, no_incomplete=True), report=report))
    asked = rows.select(F.col("id").alias("pos"), F.col("response").alias("seed"))
    stages.generate(asked, "S->C", _FEWSHOTS, Completions(_answers, retry=Retry(1)), 2, 3, report=report)
    return report.table(spark)


# Generation with stop strings, and training rows of a real vocabulary.

_STOPS = ("[Tests]", "\n\n[Exp", "# one", "zz")


def _echo(prompt, seed, sampling):
    """A model that gives its prompt back, three characters at a time."""
    return (prompt[k : k + 3] for k in range(0, len(prompt), 3))


@query(R + f""", g AS (SELECT id, response, least(200 - len(response), 40) AS room FROM resp),
    t AS (SELECT id, room, response[1:3 * room] AS t, 3 * room < len(response) AS more FROM g WHERE room > 0),
    s AS (SELECT *, list_min([{', '.join(f"CASE WHEN strpos(t, {derived._sql(x, 'id')}) > 0 THEN strpos(t, {derived._sql(x, 'id')}) + {len(x) - 1} END" for x in _STOPS)}]) AS stop FROM t),
    f AS (SELECT *, CASE WHEN stop IS NULL THEN 0 {' '.join(f"WHEN ends_with(t[1:stop], {derived._sql(x, 'id')}) THEN {len(x)}" for x in _STOPS)} END AS size FROM s)
    SELECT id, CASE WHEN stop IS NOT NULL THEN 'stop' WHEN more THEN 'length' ELSE 'eos_token' END AS reason, CASE WHEN stop IS NULL THEN t ELSE t[1:stop - size] END AS text FROM f
    UNION ALL SELECT id, 'the prompt fills the context', NULL FROM g WHERE room <= 0""")
def generation_stops(spark, sf_dir):
    """Answers cut at the first stop string, also one that spans pieces, and never beyond the context; a letter is a token here."""
    from .backends.generation import Generator
    from .backends.services import Sampling

    rows = responses(spark, sf_dir).select("id", F.col("response").alias("prompt"), F.col("id").alias("seed_value"))
    done = Generator(_echo, F.length, 200, Sampling(max_tokens=40, stop=_STOPS)).apply(rows)
    return done.select("id", F.coalesce(F.col("choices")[0]["finish_reason"], F.col("error")).alias("reason"), F.col("choices")[0]["text"].alias("text"))


def vocabulary() -> K.Tokenizer:
    """A public vocabulary whose file all executors have."""
    import public_tokenizers

    return K.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"), eos="<|endoftext|>")


@query()
def sft_vocabulary(spark, sf_dir):
    """Supervised rows of all responses by a vocabulary's ids."""
    return stages.supervised(responses(spark, sf_dir), 100, tokenizer=vocabulary()).select("id", "input_ids", "labels", "exceeding_length")


@query()
def collate_vocabulary(spark, sf_dir):
    """The same, padded to the longest of their batch of eight."""
    examples = stages.supervised(responses(spark, sf_dir), 100, tokenizer=vocabulary())
    return K.collate(examples.select("id", F.floor(F.col("id") / 8).alias("batch"), "input_ids", "labels"), "batch", vocabulary().pad_id)


@query()
def judge_vocabulary(spark, sf_dir):
    """The judge stage with a cap in a vocabulary's tokens."""
    from .backends.services import Batched

    return stages.judged(code(spark, sf_dir), list(_JUDGED), Batched(), vocabulary().count, 240, 5, "content", "doc_id").select("doc_id")


@query(ORACLES["near_dup_clusters"].replace(">= 0.8", ">= 0.5"))
def near_dup_clusters_half(spark, sf_dir):
    """Near-duplicate classes at the lower threshold."""
    return dedup.near(docs(spark, sf_dir).select("doc_id", "text"), "text", "doc_id", 0.5)


# Prompts of every mode, code-only responses, executed rows, files there and back.


def _fewshot_sql(mode: str, given: str) -> str:
    """The prompt of a mode: two drawn examples and the open slot around given, SQL for a text."""
    shown = {k: e.render(mode) for k, e in enumerate(_FEWSHOTS.valid(mode))}
    drawn = ", ".join(f"{{'d': CAST('0x' || md5('5|' || doc_id || '|fewshots|{k}')[1:13] AS BIGINT), 'i': {k}, 't': {derived._sql(t, 'doc_id')}}}" for k, t in shown.items())
    before, after = prompts.PREFIXES[mode]
    head = derived._sql(f"{_FEWSHOTS.systems[mode]}\n\n", "doc_id")
    slot = f"{derived._sql(f'## Example 3{chr(10)}{before}', 'doc_id')} || {given} || {derived._sql(after.rstrip(), 'doc_id')}"
    body = f"array_to_string(list_transform(list_sort([{drawn}])[1:2], lambda s, k: '## Example ' || k || chr(10) || s.t), chr(10) || chr(10))"
    return f"SELECT doc_id, '{mode}' AS mode, {head} || {body} || chr(10) || chr(10) || {slot} AS prompt FROM documents"


_PROPERTY_SQL = "'category: x' || chr(10) || 'language: ' || lang || chr(10) || 'concepts: a, b' || chr(10) || 'difficulty: hard'"


@query(" UNION ALL ".join(_fewshot_sql(mode, given) for mode, given in (("S->C", "source"), ("I->R", "source"), ("C->I", _PROPERTY_SQL))))
def fewshot_modes(spark, sf_dir):
    """Requests of all three modes; an example without a solution serves no response request."""
    d = docs(spark, sf_dir)
    p = F.struct(F.lit("x").alias("category"), F.col("lang").alias("language"), F.array(F.lit("a"), F.lit("b")).alias("concepts"), F.lit("hard").alias("difficulty"))
    given = {"S->C": F.col("source"), "I->R": F.col("source"), "C->I": T.render_properties(p)}
    parts = [d.select("doc_id", F.lit(mode).alias("mode"), prompts.request_prompt(_FEWSHOTS, mode, 2, 5, g, F.col("doc_id")).alias("prompt")) for mode, g in given.items()]
    return reduce(DataFrame.unionByName, parts)


_AROUND = "Then prose.\n\n{f}python\ny = 1\n{f}\n\n[Explanation]"
# A variant whose implementation is words alone gets its block from what is added.
_CODE_ONLY = {v: "\n\n".join((_KEPT[v][0], _KEPT[v][1].removesuffix("\n{f}") + "\n\ny = 1\n{f}", _KEPT[v][2], _KEPT[v][3])) for v in _KEPT}
_CODE_ONLY[9] = "Think.\n\n{f}python\ny = 1\n{f}\n\nNone {id}.\n\n{f}python\nassert True\n{f}"


@query(R + f" SELECT id, {derived.case(_CODE_ONLY, 'id', 13)} AS response FROM resp WHERE id % 13 IN ({', '.join(map(str, sorted(_CODE_ONLY)))})")
def sanitize_code_only(spark, sf_dir):
    """Implementations of two blocks with prose between them become one block."""
    more = F.expr(derived._sql(_AROUND.replace("{f}", derived.FENCE), "id"))
    rows = responses(spark, sf_dir).withColumn("response", F.replace("response", F.lit("[Explanation]"), more))
    return sanitize.sanitize(rows, sanitize.Flags(code_only=True)).select("id", "response")


@query(R + r""", x AS (SELECT id, array_to_string(list_filter(regexp_extract_all(response, '(?ms)^```python[ ]*\n(.*?)^```', 1), lambda x: NOT contains(x, '/ note')), chr(10)) AS code FROM resp)
    SELECT id FROM x WHERE code <> '' AND (code IN (SELECT code FROM x WHERE id % 5 = 0) OR NOT contains(code, 'f(3)'))""")
def execution_stage(spark, sf_dir):
    """Responses that pass: code of an earlier run's responses by the cache, other code by a stand-in that judges its text."""
    from .backends.services import Executor

    rows = responses(spark, sf_dir)
    return stages.execution_filter(rows, Executor(run=lambda code: "f(3)" not in code, at_once=1), rows.filter("id % 5 = 0")).select("id")


@query("SELECT doc_id, md5(text) AS digest, lang, CAST(NULL AS VARCHAR) AS nothing FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """Documents as JSON lines, and back under a schema in strict mode; keys with null values stay."""
    path = scratch_path(spark)
    files.write_jsonl(docs(spark, sf_dir).select("doc_id", "text", "lang", F.lit(None).cast("string").alias("nothing")), path)
    back = files.read_jsonl(spark, path, "doc_id long, text string, lang string, nothing string")
    return back.select("doc_id", F.md5("text").alias("digest"), "lang", "nothing")


@query("SELECT item_id, text || chr(10) AS text FROM benchmark")
def whole_text_files(spark, sf_dir):
    """Each benchmark item as a file of its own, read as whole texts."""
    path = scratch_path(spark)
    bench(spark, sf_dir).select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(path)
    found = files.read_whole_texts(spark, f"{path}/item_id=*/part-*")
    return found.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), "text")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'again' ELSE 'first' END AS run FROM documents")
def committed_chunks(spark, sf_dir):
    """Three chunks by commits, of which one is repeated and takes its own place."""
    table = commits.Table(spark, scratch_path(spark))
    rows = docs(spark, sf_dir).select("doc_id", F.lit("first").alias("run"))
    for k in range(3):
        table.write(rows.filter(F.col("doc_id") % 3 == k), chunk=k)
    table.write(rows.filter("doc_id % 3 = 0").withColumn("run", F.lit("again")), chunk=0)
    return table.read("doc_id long, run string")


@query(M + r", l AS (SELECT doc_id, content, regexp_split_to_array(content, '\r\n|[\n\r\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]') AS x FROM modules) SELECT doc_id, array_to_string(CASE WHEN x[len(x)] = '' THEN x[1:len(x) - 1] ELSE x END, '|') AS lines FROM l")
def module_lines(spark, sf_dir):
    """Lines at line ends of all kinds."""
    return modules(spark, sf_dir).select("doc_id", F.array_join(T.splitlines(F.col("content")), "|").alias("lines"))


@query("SELECT name, text, count(*) AS n FROM (SELECT ['humaneval-', 'humaneval-', 'mbpp-'][1 + item_id % 3] || ['cpp', 'py', 'ts'][1 + item_id // 3 % 3] || CASE WHEN item_id % 3 = 1 THEN '-remove' ELSE '' END AS name, trim(text) AS text FROM benchmark) GROUP BY name, text")
def multi_language_sources(spark, sf_dir):
    """The sets of the multi-language benchmark, each a table of its own under one root; sets that are not there are empty."""
    item = F.col("item_id")
    lang = F.element_at(F.array(*map(F.lit, ("cpp", "py", "ts"))), (1 + F.floor(item / 3) % 3).cast("int"))
    name = F.concat(F.when(item % 3 == 2, "mbpp-").otherwise("humaneval-"), lang, F.when(item % 3 == 1, "-remove").otherwise(""))
    path = scratch_path(spark)
    bench(spark, sf_dir).select(name.alias("set"), F.col("text").alias("prompt")).write.partitionBy("set").parquet(path)
    return decontam.multi_language(files.table_reader(spark, path + "/set={name}", "prompt string")).groupBy("name", "text").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE len(string_split(text, chr(10))) <= 20")
def resumable_stream(spark, sf_dir):
    """Documents as JSON files through the resumable stream into committed chunks; a second run finds nothing new."""
    source, out = scratch_path(spark), commits.Table(spark, scratch_path(spark))
    rows = docs(spark, sf_dir).select("doc_id", "text")
    # As many files as the table has splits, so that neither a file nor a task grows with it; always three batches.
    n = max(5, rows.rdd.getNumPartitions())
    files.write_jsonl(rows.repartition(n), source)
    out.guard("abc12", 0)
    check = scratch_path(spark)
    stage = lambda df: df.filter(filters.few_lines(F.col("text"), 20)).select("doc_id", F.length("text").cast("long").alias("n"))
    for _ in range(2):
        resumable.run(spark, source, "doc_id long, text string", stage, out.path, check, -(-2 * n // 5), table=out).awaitTermination()
    return out.read("doc_id long, n long")


# The chains from end to end.

def _gathered() -> str:
    """The gathering chain: functions of all variants, numbered by their digests; near copies are the variants of one text with more white space."""
    places = {(v, p): text for v, texts in _FUNCTIONS.items() for p, text in enumerate(texts.replace("|async", "|\0async").split("|"))}
    found = " UNION ".join(f"SELECT {derived._sql(t.replace(chr(0), ''), 'doc_id')} AS content, {v} AS v, {p} AS p, doc_id AS key FROM documents WHERE doc_id % 12 = {v}" for (v, p), t in places.items())
    docs_sql = "CASE v WHEN 0 THEN 'Return x plus ' || key || '.' || chr(10) || chr(10) || '    Any number.' WHEN 11 THEN CASE p WHEN 0 THEN 'Doc ' || key || '.' ELSE 'More.' END ELSE 'Doc.' END"
    quoted = f"chr(34) || chr(34) || chr(34) || {docs_sql} || chr(34) || chr(34) || chr(34)"
    return f"""WITH all_ AS ({found}), one AS (SELECT content, min(v) AS v, min(p) AS p, min(key) AS key, sha1(content) AS sha1 FROM all_ GROUP BY content),
    n AS (SELECT *, row_number() OVER (ORDER BY sha1, content) - 1 AS id FROM one),
    u AS (SELECT * FROM n WHERE v IN (0, 11) OR (v = 10 AND id = (SELECT min(id) FROM n WHERE v = 10))),
    d AS (SELECT *, {docs_sql} AS doc, replace(content, {quoted}, '') AS code FROM u),
    q AS (SELECT *, CASE WHEN CAST('0x' || md5('5|' || id || '|judge|0')[1:13] AS BIGINT) < CAST('0x' || md5('5|' || id || '|judge|1')[1:13] AS BIGINT) THEN {_SHOWN[0]} || chr(10) || chr(10) || {_SHOWN[1]} ELSE {_SHOWN[1]} || chr(10) || chr(10) || {_SHOWN[0]} END
          || chr(10) || chr(10) || {_ask_sql('doc', 'code')} AS prompt FROM d)
    SELECT id, sha1, content FROM q WHERE md5(prompt)[1:1] < '8' AND {_fits_sql(_JUDGE_ROOM + 99)}"""


@query(_gathered())
def chain_gather(spark, sf_dir):
    """From source files to judged seeds, near copies at the lower threshold and inferred imports included; a letter is a token here."""
    how = chains.Gathering(_JUDGED, F.length, most=_JUDGE_ROOM + 99, seed=5)
    return chains.gather(code(spark, sf_dir), bench(spark, sf_dir).select("text"), how)


def _asked_sql(mode: str, given: str, rows: str) -> str:
    """A mode's requests for rows with pos."""
    return _fewshot_sql(mode, given).replace("'5|' || doc_id", "'5|' || pos").replace("SELECT doc_id, ", "SELECT *, ").replace("FROM documents", f"FROM {rows}")


def _answer_sql(k: int) -> str:
    return f"sha256('stand-in|' || (5 + pos) || '|{k}|' || prompt)"


_TEXT = "{d}[1:8] || ', ' || {d}[9:16]"
_DRAWN = f"'category: {prompts.CATEGORY}' || chr(10) || 'language: Python' || chr(10) || 'concepts: ' || concepts || chr(10) || 'difficulty: ' || (['easy', 'medium', 'hard'])[1 + CAST('0x' || md5('5|' || pos || '|difficulty')[1:13] AS BIGINT) % 3]"


def _instructed() -> str:
    given = {"S->C": ("seed", "p"), "C->I": (_DRAWN, "c"), "I->R": ("instruction", "i")}
    asked = {m: _asked_sql(m, g, r) for m, (g, r) in given.items()}
    d = {k: f"d{k}" for k in (0, 1)}
    renders = "".join(e.render("I->R") for e in _FEWSHOTS.examples)
    return f"""WITH p AS (SELECT doc_id, 'snippet ' || doc_id AS seed, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
    c AS (SELECT doc_id, seed, pos, {_TEXT.format(d='d')} AS concepts FROM (SELECT *, {_answer_sql(0)} AS d FROM ({asked['S->C']})) WHERE d[1:1] <> '0'),
    i AS (SELECT doc_id, seed, pos, concepts, {_TEXT.format(d='d')} AS instruction FROM (SELECT *, {_answer_sql(0)} AS d FROM ({asked['C->I']})) WHERE d[1:1] <> '0'),
    r AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {x}[1:1] <> '0' THEN {_TEXT.format(d=x)} END" for x in d.values())}], lambda x: x IS NOT NULL) AS found FROM (SELECT *, {', '.join(f'{_answer_sql(k)} AS {x}' for k, x in d.items())} FROM ({asked['I->R']})))
    SELECT doc_id, pos, concepts, instruction, array_to_string(found, '|') AS responses, md5(prompt) AS prompt, sha256({derived._sql(f'I->Rstand-in25{renders}', 'pos')})[1:5] AS fingerprint FROM r WHERE len(found) > 0"""


@query(_instructed())
def chain_instruct(spark, sf_dir):
    """Concepts, instructions and two responses for every snippet, in committed chunks; the second run finds all of them there."""
    from .backends.services import Completions, Sampling

    seeds = docs(spark, sf_dir).select("doc_id", F.concat(F.lit("snippet "), F.col("doc_id").cast("string")).alias("seed"))
    total, folder = seeds.count(), scratch_path(spark)
    modes = [chains.Mode("S->C", 2, Completions()), chains.Mode("C->I", 2, Completions()), chains.Mode("I->R", 2, Completions(sampling=Sampling(n=2, temperature=0.7)))]
    for _ in range(2):
        done = chains.instruct(seeds, ["doc_id"], _FEWSHOTS, modes, folder, chunk=total // 3 + 1, seed=5)
    responses_ = F.array_join(F.transform("parsing_result", lambda x: x["response"]), "|")
    return done.select("doc_id", "pos", F.array_join("concepts", ", ").alias("concepts"), "instruction", responses_.alias("responses"), F.md5("prompt").alias("prompt"), "fingerprint")


def _of_samples(sql: str) -> str:
    """SQL about responses by their id as SQL about samples: q is the response's number, key names the sample in draws."""
    sql = sql.replace("'0|' || id", "'0|' || key").replace("CAST(id AS STRING)", "CAST(q AS STRING)").replace("'assert f(1) == ' || id", "'assert f(1) == ' || q")
    return re.sub(r"\bid % 13", "q % 13", sql).replace("CASE id ", "CASE q ")


_NEXT = derived.RESPONSE_SQL.replace("doc_id", "(doc_id + 1)")


def _curated() -> str:
    # The first pass cuts the tests of variant 12 in the middle of their block, which the second one then refuses as no whole block.
    tail = _of_samples(_ASSERTIONS.removeprefix(R)).replace("SELECT id, instruction", "SELECT key, q, instruction").replace("FROM resp", "FROM cleaned")
    smart = _of_samples(f""", s AS (SELECT *, contains(lower(instruction), 'test') AS asks, {_draw_sql('explanation')} < {_HALF} AS de, {_draw_sql('reasoning')} < {_HALF} AS dr, {_draw_sql('augment')} < {_HALF} AS au FROM a WHERE id % 13 NOT IN (6, 12))
    SELECT key AS sample_id, CASE WHEN au AND NOT asks THEN instruction || more ELSE instruction END AS instruction, CASE {' '.join(f'WHEN {c} THEN {x}' for c, x in _SMART)} END AS response FROM s""")
    return f"""WITH RECURSIVE resp AS (SELECT doc_id AS id, doc_id + s AS q, doc_id || '-' || s AS key, {derived.INSTRUCTION_SQL} AS instruction, CASE s WHEN 0 THEN {derived.RESPONSE_SQL} ELSE {_NEXT} END AS response FROM documents, generate_series(0, 1) g(s)),
    x AS (SELECT *, array_to_string(list_filter(regexp_extract_all(response, '(?ms)^```python[ ]*\\n(.*?)^```', 1), lambda x: NOT contains(x, '/ note')), chr(10)) AS code FROM resp),
    ran AS (SELECT * FROM x WHERE code <> '' AND (code IN (SELECT code FROM x WHERE id % 5 = 0) OR NOT contains(code, 'f(3)'))),
    raw AS (SELECT q, key, instruction, {_of_samples(_kept(0, 1, 2, 3, tags=True))} AS response FROM ran WHERE q % 13 IN (0, 1, 6, 10, 12)),
    ks AS (SELECT key, [regexp_replace(instruction, '{_WS}', '', 'g'), regexp_replace(response, '{_WS}', '', 'g')] AS keys, row_number() OVER (ORDER BY CAST('0x' || md5('0|' || key)[1:13] AS BIGINT), key) AS r FROM raw),
    g AS (SELECT 0::BIGINT AS r, []::VARCHAR[] AS seen, NULL::VARCHAR AS key UNION ALL
          SELECT ks.r, CASE WHEN list_has_any(g.seen, ks.keys) THEN g.seen ELSE list_concat(g.seen, ks.keys) END, CASE WHEN list_has_any(g.seen, ks.keys) THEN NULL ELSE ks.key END FROM g JOIN ks ON ks.r = g.r + 1),
    cleaned AS (SELECT raw.* FROM raw SEMI JOIN g USING (key)){tail}{smart}"""


@query(_curated())
def chain_curate(spark, sf_dir):
    """Two responses a row: executed (with an earlier run's as cache), sanitized, cleaned, and sanitized as the row decides."""
    from .backends.services import Executor

    both = F.array(*(F.struct(F.expr(sql).alias("response")) for sql in (derived.RESPONSE_SQL, _NEXT)))
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.expr(derived.INSTRUCTION_SQL).alias("instruction"), both.alias("parsing_result"))
    kept = chains.curate(rows, Executor(run=lambda code: "f(3)" not in code, at_once=1), rows.filter("id % 5 = 0"))
    return kept.select("sample_id", "instruction", "response")


_SOLVED = "md5(trim(text) || d[1:8] || ', ' || d[9:16])[1:1] < '6'"


@query(f"""WITH p AS (SELECT item_id, text, s, '{prompts.SYSTEM}' || chr(10) || chr(10) || '### Instruction' || chr(10) || 'Write a Python function to solve the given task:' || chr(10) || '```python' || chr(10) || trim(text) || chr(10) || '```' || chr(10) || chr(10) || '### Response' || chr(10) || chr(10) || '```python' || chr(10) || trim(text) AS prompt FROM benchmark, generate_series(0, 9) g(s)),
    a AS (SELECT *, sha256('stand-in|' || (3407 + s) || '|0|' || prompt) AS d FROM p), c AS (SELECT item_id, count(*) AS n, count(*) FILTER ({_SOLVED}) AS c FROM a GROUP BY item_id)
    SELECT CAST(item_id AS VARCHAR) AS id, n, c, CASE WHEN c > 7 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE round(1 - list_product([1 - 3.0 / i FOR i IN generate_series(n - c + 1, n)]), 6) END AS p FROM c""")
def chain_evaluate(spark, sf_dir):
    """Ten completions of every benchmark item, cut, run by a stand-in that judges the code's text, and pass@3."""
    import hashlib

    from .backends.services import Completions, Executor

    problems = bench(spark, sf_dir).select(stages.humaneval_problem(F.col("text"), F.col("item_id")).alias("p")).select("p.*")
    found = chains.evaluate(problems, 10, 3, Completions(), Executor(run=lambda code: hashlib.md5(code.encode()).hexdigest()[0] < "6", at_once=1))
    return found.select("id", "n", "c", F.round("pass_at_k", 6).alias("p"))


# Further sources and sinks.


@query("SELECT 'prompt_files' AS name, CASE WHEN item_id % 3 = 2 THEN text || ' BEGIN' || chr(10) ELSE text || chr(10) END AS text FROM benchmark")
def prompt_file_sets(spark, sf_dir):
    """A benchmark of one file a prompt, in folders of its own, as a set: each up to its solution's mark."""
    path = scratch_path(spark)
    item = F.col("item_id")
    marked = F.concat("text", F.when(item % 3 == 0, F.lit("\nSOLUTION START\nx = 1")).when(item % 3 == 1, F.lit("\nBEGIN SOLUTION\nx = 1")).otherwise(F.lit(" BEGIN\nSOLUTION START\nBEGIN SOLUTION")))
    bench(spark, sf_dir).select(item.alias("q"), marked.alias("text")).repartition("q").write.partitionBy("q").text(path)
    found = files.read_whole_texts(spark, f"{path}/q=*/part-*")
    return decontam.prompt_files(found)


@query("SELECT doc_id, lang, md5(text) AS digest FROM documents")
def table_round_trip(spark, sf_dir):
    """Documents as a table in folders by language (null is one too) and back, three columns of it."""
    path = scratch_path(spark)
    files.write_table(docs(spark, sf_dir), path, ["lang"])
    return files.read_table(spark, path, ["doc_id", "lang", "text"]).select("doc_id", "lang", F.md5("text").alias("digest"))


@query("SELECT doc_id, doc_id % 3 = 0 AS cached FROM documents")
def cached_rows_first(spark, sf_dir):
    """A sink that begins anew with its own rows of before, and then new ones."""
    path, schema = scratch_path(spark), "doc_id long, cached boolean"
    rows = docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 3 == 0).alias("cached"))
    files.write_jsonl(rows.filter("cached"), path)
    files.write_after_cached(files.read_jsonl(spark, path, schema), rows.filter("NOT cached"), path)
    return files.read_jsonl(spark, path, schema)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 2 = 1 THEN source END AS source FROM documents")
def input_union(spark, sf_dir):
    """Two inputs of different keys as one table, in one scan."""
    d, paths = docs(spark, sf_dir), [scratch_path(spark), scratch_path(spark)]
    for k, column in enumerate(("lang", "source")):
        files.write_jsonl(d.filter(F.col("doc_id") % 2 == k).select("doc_id", column), paths[k])
    return files.read_jsonl(spark, paths, "doc_id long, lang string, source string")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents")
def file_positions(spark, sf_dir):
    """Positions of JSON lines in the order of files and of lines within them."""
    path = scratch_path(spark)
    files.write_jsonl(docs(spark, sf_dir).select("doc_id").repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id"), path)
    return files.read_jsonl_with_pos(spark, path, "doc_id long").select("doc_id", "pos")


@query("SELECT event_type, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, count(*) AS n FROM events GROUP BY 1, 2")
def event_timestamps(spark, sf_dir):
    """Times as parts of file names."""
    return table(spark, sf_dir, "events").groupBy("event_type", T.timestamp(F.col("ts")).alias("stamp")).agg(F.count("*").alias("n"))
