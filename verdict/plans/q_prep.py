"""Preparation keys: label vocabularies, image paths, dense index,
enrichment, prompts, answer parsing, key parsing, path rewriting,
incremental enrichment, batch scorer, evidence corpus, nested claims."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.scorers import token_count_scorer
from ..functions.labels import (category_code, collapse_labels, expand_category, labels_key,
                                parse_answer_label, simple_code, simplify, strip_ws)
from ..operators import prep
from ..operators.retrieval import hydrate
from ..operators.topk import vector_topk
from ..schemas import CATEGORIES, CATEGORY_PATH_LABELS, PATHS, SIMPLE_CLASSES, SIMPLIFIED
from .bindings import SQL_GOLD, corpus_from, queries_from, sql_scores
from ..session import spread
from .registry import Tables, register

_CATS6 = CATEGORIES + ["Other"]


def _category(t):
    m = F.create_map(*[x for i, c in enumerate(_CATS6) for x in (F.lit(i), F.lit(c))])
    return t.embeddings.select("vec_id", m[F.col("label") % 6].alias("category"))


_SQL_CAT = ("WITH c AS (SELECT vec_id, CASE label % 6 "
            + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CATS6)) + " END AS category FROM embeddings)")


def _sql_path_label(i: int) -> str:
    return ("CASE category " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in CATEGORY_PATH_LABELS.items())
            + " ELSE 1 END")


_SHORT = ["l_tt", "l_ti", "l_it", "l_ii"]


@register("expand_labels", f"""{_SQL_CAT}
SELECT vec_id, category, {', '.join(f'{_sql_path_label(i)} AS {_SHORT[i]}' for i in range(4))} FROM c""", "P5 P8")
def q_expand_labels(spark, sf_dir):
    c = _category(Tables(spark, sf_dir))
    a = expand_category(F.col("category"))
    return c.select("vec_id", "category", *[a[i].alias(n) for i, n in enumerate(_SHORT)])


_SQL_DIGITS = "(vec_id % 3) || ',' || (vec_id // 3 % 3) || ',' || (vec_id // 9 % 3) || ',' || (vec_id // 27 % 3)"
_SQL_COLLAPSE = ("CASE key " + " ".join(f"WHEN '{','.join(map(str, v))}' THEN '{k}'"
                                        for k, v in CATEGORY_PATH_LABELS.items()) + " ELSE 'Insufficient_Text' END")
_SQL_CODE = "CASE {x} " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATEGORIES)) + " END"


@register("collapse_labels", f"""SELECT vec_id, key AS labels_key, {_SQL_COLLAPSE} AS category,
       {_SQL_CODE.format(x=_SQL_COLLAPSE)} AS category_idx
FROM (SELECT vec_id, {_SQL_DIGITS} AS key FROM embeddings)""", "P6 P8")
def q_collapse_labels(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    v = F.col("vec_id")
    labels = F.array(*[(F.floor(v / d) % 3).cast("int") for d in (1, 3, 9, 27)])
    c = e.select("vec_id", labels.alias("labels"))
    cat = collapse_labels(F.col("labels"))
    return c.select("vec_id", labels_key(F.col("labels")).alias("labels_key"), cat.alias("category"),
                    category_code(cat).alias("category_idx"))


@register("simplify_labels", f"""{_SQL_CAT}
SELECT vec_id, category, CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SIMPLIFIED.items())} END AS simple,
       CASE CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SIMPLIFIED.items())} END
            {' '.join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(SIMPLE_CLASSES))} END AS simple_idx
FROM c""", "P7 P8")
def q_simplify_labels(spark, sf_dir):
    c = _category(Tables(spark, sf_dir))
    s = simplify(F.col("category"))
    return c.select("vec_id", "category", s.alias("simple"), simple_code(s).alias("simple_idx"))


@register("unpivot_paths", f"""{_SQL_CAT},
w AS (SELECT vec_id, {', '.join(f'{_sql_path_label(i)} AS {PATHS[i]}' for i in range(4))} FROM c)
SELECT vec_id, path, label, path = 'text_text' AS is_truth_path
FROM (UNPIVOT w ON {', '.join(PATHS)} INTO NAME path VALUE label)""", "P24 P23")
def q_unpivot_paths(spark, sf_dir):
    c = _category(Tables(spark, sf_dir))
    a = expand_category(F.col("category"))
    w = c.select("vec_id", *[a[i].alias(p) for i, p in enumerate(PATHS)])
    u = w.unpivot("vec_id", PATHS, "path", "label")
    return u.withColumn("is_truth_path", F.col("path") == "text_text")


# image listing derived from labels: quality = 1 -> claim image, toxic = 0 ->
# evidence image, quality = 0 -> an unrelated file name that must not match
def _listing(t):
    lab = t.labels
    d = F.col("doc_id").cast("string")
    return (lab.filter(F.col("quality") == 1).select(F.concat(F.lit("images/"), d, F.lit("_claim.jpg")).alias("path"))
            .unionByName(lab.filter(F.col("toxic") == 0)
                         .select(F.concat(F.lit("images/"), d, F.lit("_evidence.jpg")).alias("path")))
            .unionByName(lab.filter(F.col("quality") == 0)
                         .select(F.concat(F.lit("images/"), d, F.lit("_evidence_x.jpg")).alias("path"))))


_SQL_LISTING = """listing AS (
  SELECT 'images/' || doc_id || '_claim.jpg' AS path FROM labels WHERE quality = 1
  UNION ALL SELECT 'images/' || doc_id || '_evidence.jpg' FROM labels WHERE toxic = 0
  UNION ALL SELECT 'images/' || doc_id || '_evidence_x.jpg' FROM labels WHERE quality = 0),
att AS (SELECT d.doc_id,
          (SELECT max(path) FROM listing WHERE path = 'images/' || d.doc_id || '_claim.jpg') AS claim_image,
          (SELECT max(path) FROM listing WHERE path = 'images/' || d.doc_id || '_evidence.jpg') AS evidence_image
        FROM documents d)"""


def _attached(t):
    return prep.attach_paths(t.documents.select("doc_id"), _listing(t), id_col="doc_id")


@register("attach_path", f"WITH {_SQL_LISTING} SELECT * FROM att", "P1 S10 S11 J15")
def q_attach_path(spark, sf_dir):
    return _attached(Tables(spark, sf_dir))


@register("complete_samples", f"""WITH {_SQL_LISTING}
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id
FROM att WHERE claim_image IS NOT NULL AND evidence_image IS NOT NULL""", "P4 W7")
def q_complete_samples(spark, sf_dir):
    c = prep.complete_modality(_attached(Tables(spark, sf_dir)))
    return prep.dense_index(c.select("doc_id"), "doc_id")


# caption derived from labels: quality 1 -> 'image of {source}', 0 -> '',
# not labelled -> null
def _captioned(t):
    lab = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = t.documents.select("doc_id", "text", "source").join(lab, "doc_id", "left")
    cap = F.when(F.col("quality") == 1, F.concat(F.lit("image of "), F.col("source"))) \
        .when(F.col("quality") == 0, F.lit(""))
    return d.select("doc_id", "text", cap.alias("caption"))


_SQL_CAPTION = """cap AS (SELECT d.doc_id, d.text,
  CASE WHEN l.quality = 1 THEN 'image of ' || d.source WHEN l.quality = 0 THEN '' END AS caption
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l
  ON l.doc_id = d.doc_id)"""


@register("enrich_text", f"""WITH {_SQL_CAPTION}
SELECT doc_id, caption, coalesce(text, 'nan') || '. ' || coalesce(caption, 'nan') AS enriched_batch,
       CASE WHEN length(caption) > 0 THEN text || '. ' || caption ELSE text END AS enriched_online
FROM cap""", "P9a P9b")
def q_enrich_text(spark, sf_dir):
    c = _captioned(Tables(spark, sf_dir))
    return c.select("doc_id", "caption", prep.enrich_batch(F.col("text"), F.col("caption")).alias("enriched_batch"),
                    prep.enrich_online(F.col("text"), F.col("caption")).alias("enriched_online"))


@register("incremental_enrich", f"""WITH {_SQL_CAPTION.replace("CASE WHEN l.quality = 1 THEN 'image of ' || d.source WHEN l.quality = 0 THEN '' END", "'image of ' || d.source")}
SELECT doc_id, CASE WHEN length(caption) > 0 THEN text || '. ' || caption ELSE text END AS enriched
FROM cap WHERE doc_id NOT IN (SELECT doc_id FROM labels)""", "R1 J14")
def q_incremental_enrich(spark, sf_dir):
    t = Tables(spark, sf_dir)
    todo = prep.pending(t.documents.select("doc_id", "text", "source"), t.labels, "doc_id")
    cap = F.concat(F.lit("image of "), F.col("source"))
    return todo.select("doc_id", prep.enrich_online(F.col("text"), cap).alias("enriched"))


QUESTION = "Is the claim supported by the evidence?"


def _sql_template(tpl: str) -> str:
    """The same template as a SQL ``||`` chain of quoted literals and slots."""
    slots = {"question": f"'{QUESTION}'", "claim": "b.text", "evidence": "d.text"}
    out, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", tpl):
        if tpl[pos:m.start()]:
            out.append("'" + tpl[pos:m.start()].replace("'", "''") + "'")
        out.append(slots[m.group(1)])
        pos = m.end()
    if tpl[pos:]:
        out.append("'" + tpl[pos:].replace("'", "''") + "'")
    return " || ".join(out) if out else "''"


@register("build_prompts", "SELECT b.item_id, t.template, t.prompt FROM benchmark b JOIN documents d ON d.doc_id = b.item_id,\n"
          + "LATERAL (SELECT unnest([" + ", ".join(f"'{k}'" for k in prep.PROMPTS) + "]) AS template, unnest(["
          + ", ".join(_sql_template(v) for v in prep.PROMPTS.values()) + "]) AS prompt) t", "P10")
def q_build_prompts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.benchmark.select("item_id", F.col("text").alias("claim")).join(
        t.documents.select(F.col("doc_id").alias("item_id"), F.col("text").alias("evidence")), "item_id")
    slots = {"question": F.lit(QUESTION), "claim": F.col("claim"), "evidence": F.col("evidence")}
    arr = F.array(*[F.struct(F.lit(k).alias("template"), prep.fill_template(v, slots).alias("prompt"))
                    for k, v in prep.PROMPTS.items()])
    return j.select("item_id", F.explode(arr).alias("r")).select("item_id", "r.template", "r.prompt")


# generated answers bound to conversations: assistant turns; turn % 4 = 1
# wraps the text after the answer marker
def _answers(t):
    c = t.conversations.filter(F.col("role") == "assistant")
    g = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("Verify the claim. ### Answer: "), F.col("text"))) \
        .otherwise(F.col("text"))
    return c.select("conv_id", "turn", g.alias("generated"))


_SQL_ANSWERS = """a AS (SELECT conv_id, turn,
  CASE WHEN turn % 4 = 1 THEN 'Verify the claim. ### Answer: ' || text ELSE text END AS generated
  FROM conversations WHERE role = 'assistant')"""
_SQL_LAST = "lower(list_last(string_split(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), chr(10))))"
_SQL_P11 = ("CASE WHEN contains({l}, 'support') THEN 0 WHEN contains({l}, 'refute') OR contains({l}, 'false') "
            "THEN 2 ELSE 1 END")


@register("parse_answers", f"""WITH {_SQL_ANSWERS}
SELECT conv_id, turn, {_SQL_P11.format(l=_SQL_LAST.format(x='generated'))} AS label,
       contains(generated, '### Answer:') AS has_marker,
       CASE WHEN contains(generated, '### Answer:')
            THEN lower(regexp_replace(split_part(generated, '### Answer:', 2), '^\\s+|\\s+$', '', 'g'))
            ELSE generated END AS answer
FROM a""", "P11 P12 F11")
def q_parse_answers(spark, sf_dir):
    parsed, _ = prep.parse_answers(_answers(Tables(spark, sf_dir)), "generated")
    return parsed.select("conv_id", "turn", "label", "has_marker", "answer")


@register("answer_rejects", f"""WITH {_SQL_ANSWERS}
SELECT conv_id, turn FROM a WHERE NOT contains(generated, '### Answer:')""", "P12")
def q_answer_rejects(spark, sf_dir):
    _, rej = prep.parse_answers(_answers(Tables(spark, sf_dir)), "generated")
    return rej.select("conv_id", "turn")


@register("decode_keys", """WITH k AS (SELECT doc_id, text, source, lang,
    doc_id || '-' || CASE WHEN n_chars % 2 = 0 THEN 'proof' ELSE regexp_extract(source, '\\d+', 0) END
      || '-' || lang || '.jpg' AS name,
    CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'test' ELSE 'dev' END || '_' || doc_id AS skey
  FROM documents)
SELECT doc_id, split_part(substr(name, 1, 17), '-', 1)::BIGINT AS claim_id,
       split_part(substr(name, 1, 17), '-', 2) = 'proof' AS is_gold,
       CASE WHEN split_part(substr(name, 1, 17), '-', 2) <> 'proof'
            THEN split_part(substr(name, 1, 17), '-', 2)::BIGINT END AS rel_doc_id,
       concat_ws('-', doc_id, source, lang) AS passage_key,
       length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS value_chars,
       regexp_extract(skey, '^(train|test)_(\\d+)$', 1) AS split,
       regexp_extract(skey, '^(train|test)_(\\d+)$', 2)::BIGINT AS split_id
FROM k WHERE regexp_extract(skey, '^(train|test)_(\\d+)$', 1) <> ''""", "P13 P14 P15 F11")
def q_decode_keys(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    name = F.concat(F.col("doc_id").cast("string"), F.lit("-"),
                    F.when(F.col("n_chars") % 2 == 0, F.lit("proof"))
                    .otherwise(F.regexp_extract("source", r"\d+", 0)), F.lit("-"), F.col("lang"), F.lit(".jpg"))
    skey = F.concat(F.when(F.col("lang") == "en", "train").when(F.col("lang") == "fr", "test").otherwise("dev"),
                    F.lit("_"), F.col("doc_id").cast("string"))
    img = prep.decode_image_key(name)
    sp, sid = prep.decode_split_key(skey)
    out = d.select("doc_id", img["claim_id"].alias("claim_id"), img["is_gold"].alias("is_gold"),
                   img["rel_doc_id"].alias("rel_doc_id"),
                   prep.passage_key(F.col("doc_id"), F.col("source"), F.col("lang")).alias("passage_key"),
                   F.length(strip_ws(F.col("text"))).cast("long").alias("value_chars"),
                   sp.alias("split"), sid.cast("long").alias("split_id"))
    return out.filter(F.col("split") != "")


@register("rewrite_paths", """WITH r AS (SELECT doc_id,
    'C:\\data\\' || sp || '\\' || sp || '_' || doc_id
      || CASE WHEN n_chars % 3 = 0 THEN '_claim.jpg' ELSE '_evidence.jpg' END AS raw
  FROM (SELECT *, CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS sp FROM documents)),
b AS (SELECT doc_id, string_split(replace(raw, '\\', '/'), '/')[-1] AS name FROM r),
e AS (SELECT * FROM b WHERE split_part(string_split(name, '_')[-1], '.', 1) = 'evidence')
SELECT CASE WHEN starts_with(name, 'test') THEN 'images/test/' || regexp_extract(name, '^[^_]*_(.*)$', 1)
            WHEN starts_with(name, 'train') THEN 'images/train/' || regexp_extract(name, '^[^_]*_(.*)$', 1)
            ELSE error('no split prefix in the file name: ' || name) END AS new_path,
       max(doc_id) AS doc_id
FROM e GROUP BY 1""", "P16 P17 P18")
def q_rewrite_paths(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    sp = F.when(F.col("lang") == "en", "train").otherwise("test")
    raw = F.concat(F.lit("C:\\data\\"), sp, F.lit("\\"), sp, F.lit("_"), F.col("doc_id").cast("string"),
                   F.when(F.col("n_chars") % 3 == 0, F.lit("_claim.jpg")).otherwise(F.lit("_evidence.jpg")))
    b = d.select("doc_id", prep.basename(prep.normalise_separators(raw)).alias("name"))
    e = b.filter(prep.is_evidence_image(F.col("name")))
    r = e.select("doc_id", prep.canonical_path(F.col("name")).alias("new_path"))
    # A colliding key keeps the last row (highest position)
    return r.groupBy("new_path").agg(F.max_by("doc_id", "doc_id").alias("doc_id"))


@register("evidence_corpus", """SELECT key, split, doc_id FROM (
  SELECT 'train_' || doc_id || '_evidence.jpg' AS key, 'train' AS split, doc_id FROM documents WHERE lang = 'en'
  UNION ALL
  SELECT 'test_' || doc_id || '_evidence.jpg', 'test', doc_id FROM documents WHERE lang <> 'en')
ORDER BY key""", "U5 T3 P18")
def q_evidence_corpus(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    def half(df, split):
        return df.select(F.concat(F.lit(split + "_"), F.col("doc_id").cast("string"), F.lit("_evidence.jpg"))
                         .alias("key"), F.lit(split).alias("split"), "doc_id")
    u = half(d.filter(F.col("lang") == "en"), "train").unionByName(half(d.filter(F.col("lang") != "en"), "test"))
    return u.orderBy("key")


@register("batch_score", """SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+'))::BIGINT AS n_tokens
FROM documents""", "X2")
def q_batch_score(spark, sf_dir):
    d = spread(Tables(spark, sf_dir).documents.select("doc_id", "text"))
    return prep.batch_score(d, token_count_scorer, "doc_id long, n_tokens long")


@register("claim_gold_label", f"""SELECT conv_id,
  CASE {_SQL_P11.format(l=_SQL_LAST.format(x='text'))} WHEN 0 THEN 'supported' WHEN 2 THEN 'refuted' ELSE 'NEI' END
    AS gold_label
FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id)""", "J6 P11")
def q_claim_gold_label(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    lab = parse_answer_label(F.col("text"))
    return first.select("conv_id", F.when(lab == 0, "supported").when(lab == 2, "refuted")
                        .otherwise("NEI").alias("gold_label"))


@register("gold_truthfulness", f"""WITH g AS (SELECT conv_id, arg_min(coalesce(text, ''), turn) AS text FROM conversations GROUP BY conv_id)
SELECT d.doc_id AS claim_id, CASE {_SQL_P11.format(l=_SQL_LAST.format(x='g.text'))}
  WHEN 0 THEN 'supported' WHEN 2 THEN 'refuted' ELSE 'NEI' END AS truthfulness
FROM documents d JOIN g ON g.conv_id = d.doc_id""", "J6 P11")
def q_gold_truthfulness(spark, sf_dir):
    from ..operators.retrieval import first_per_key
    t = Tables(spark, sf_dir)
    judged = t.conversations.select(F.col("conv_id").alias("claim_id"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    first = first_per_key(judged, ["claim_id"], ["turn", "text"])
    lab = parse_answer_label(F.col("text"))
    return t.documents.select(F.col("doc_id").alias("claim_id")).join(first, "claim_id").select(
        "claim_id", F.when(lab == 0, "supported").when(lab == 2, "refuted").otherwise("NEI").alias("truthfulness"))


_SQL_CONTENT = """SELECT t.query_id, t.rank, d.doc_id, length(d.text) AS content_chars
FROM top t JOIN documents d ON d.doc_id = t.corpus_id WHERE length(d.text) > 0"""


def evidence_pool(spark, sf_dir, evidence_type: str):
    """``retrieved`` = top-5 neighbours; ``gold`` = the gold evidence
    (smallest other id with the same label), rank 1. The downstream plan is
    the same for either pool."""
    t = Tables(spark, sf_dir)
    emb = t.embeddings
    if evidence_type == "retrieved":
        return vector_topk(queries_from(emb), corpus_from(emb), 5, q_id="query_id", c_id="corpus_id",
                           exclude_self=True).select("query_id", "corpus_id", "rank")
    if evidence_type == "gold":
        from ..operators.ireval import same_label_relevance
        g = same_label_relevance(emb, id_col="vec_id", label_col="label")
        return g.filter(F.col("min_relevant").isNotNull()).select(
            "query_id", F.col("min_relevant").alias("corpus_id"), F.lit(1).cast("long").alias("rank"))
    raise ValueError(f"unknown evidence type {evidence_type!r}")


def _candidate_content(spark, sf_dir, evidence_type):
    pool = evidence_pool(spark, sf_dir, evidence_type)
    # P20; only the length goes into the join, not the text
    docs = (Tables(spark, sf_dir).documents.select("doc_id", F.length("text").cast("long").alias("content_chars"))
            .filter("content_chars > 0"))
    h = hydrate(pool, docs, hit_key=["corpus_id"], content_key=["doc_id"], order=["content_chars"])
    return h.select("query_id", "rank", "doc_id", "content_chars")


@register("candidate_content", f"""WITH {sql_scores()},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank
                       FROM s) WHERE rank <= 5)
{_SQL_CONTENT}""", "J7 P20 P22")
def q_candidate_content(spark, sf_dir):
    return _candidate_content(spark, sf_dir, "retrieved")


@register("gold_content", f"""WITH {SQL_GOLD},
top AS (SELECT query_id, gold_id AS corpus_id, 1 AS rank FROM gold WHERE gold_id IS NOT NULL)
{_SQL_CONTENT}""", "J7 P20 P22")
def q_gold_content(spark, sf_dir):
    return _candidate_content(spark, sf_dir, "gold")


@register("nested_claims", """WITH r AS (SELECT conv_id, role, count(*) AS n, sum(length(text)) AS chars
                                   FROM conversations GROUP BY conv_id, role),
m AS (SELECT conv_id, map_from_entries(list(struct_pack(k := role, v := n))) AS per_role,
             sum(n) AS n_turns, sum(chars) AS total_chars FROM r GROUP BY conv_id),
f AS (SELECT conv_id, arg_min(text, turn) AS first_text, arg_max(text, turn) AS last_text
      FROM conversations GROUP BY conv_id)
SELECT m.conv_id, m.n_turns::BIGINT AS n_turns, coalesce(per_role['user'], 0) AS n_user,
       coalesce(per_role['assistant'], 0) AS n_assistant, coalesce(per_role['system'], 0) AS n_system,
       m.total_chars::BIGINT AS total_chars, f.first_text, f.last_text
FROM m JOIN f USING (conv_id)""", "A25")
def q_nested_claims(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations
    r = c.groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    m = r.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("per_role"),
                                 F.sum("n").alias("n_turns"), F.sum("chars").alias("total_chars"))
    f = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"),
                                 F.max_by("text", "turn").alias("last_text"))
    pr = F.col("per_role")
    return m.join(f, "conv_id").select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"),
        *[F.coalesce(pr[r], F.lit(0)).cast("long").alias(f"n_{r}") for r in ("user", "assistant", "system")],
        F.col("total_chars").cast("long").alias("total_chars"), "first_text", "last_text")


@register("nested_claim_documents", """WITH i AS (
  SELECT conv_id AS claim_id, role AS doc_id, turn AS place, 'text' AS kind, text AS content FROM conversations UNION ALL
  SELECT conv_id, role, turn, 'image', conv_id || '-' || turn || '.jpg' FROM conversations WHERE role = 'assistant'),
o AS (
  SELECT *, coalesce(sum(strlen(content)) OVER (PARTITION BY claim_id ORDER BY doc_id, place, kind, content
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2000 AS segment
  FROM i WHERE length(content) > 0),
d AS (
  SELECT claim_id, segment::BIGINT AS segment, doc_id, count(*) FILTER (kind = 'text') AS texts, count(*) FILTER (kind = 'image') AS images,
    doc_id || chr(30) || coalesce(string_agg(content, chr(31) ORDER BY place, content) FILTER (kind = 'text'), '') || chr(30)
      || coalesce(string_agg(content, chr(31) ORDER BY place, content) FILTER (kind = 'image'), '') AS body
  FROM o GROUP BY 1, 2, 3)
SELECT claim_id, segment, count(*) AS n_documents, sum(texts)::BIGINT AS n_texts, sum(images)::BIGINT AS n_images,
  md5(string_agg(body, chr(29) ORDER BY doc_id)) AS content_md5
FROM d GROUP BY 1, 2""", "A25 P20")
def q_nested_claim_documents(spark, sf_dir):
    from ..operators.nested import IMAGE, TEXT, claim_documents, content_digest
    c = Tables(spark, sf_dir).conversations
    turn = c.select(F.col("conv_id").alias("claim_id"), F.col("role").alias("doc_id"), F.col("turn").alias("place"), "text")
    image = F.concat(F.col("claim_id").cast("string"), F.lit("-"), F.col("place").cast("string"), F.lit(".jpg"))
    items = turn.select("claim_id", "doc_id", "place", F.lit(TEXT).alias("kind"), F.col("text").alias("content")).unionByName(
        turn.filter("doc_id = 'assistant'").select("claim_id", "doc_id", "place", F.lit(IMAGE).alias("kind"), image.alias("content")))
    nested = claim_documents(items, segment_bytes=2000)
    count = lambda kind: F.aggregate("documents", F.lit(0).cast("long"), lambda n, d: n + F.size(d[kind]))
    return nested.select("claim_id", "segment", F.size("documents").cast("long").alias("n_documents"),
                         count("texts").alias("n_texts"), count("images").alias("n_images"),
                         content_digest().alias("content_md5"))


@register("metrics_history_latest", """WITH h AS (SELECT 'user_' || user_id AS model, ts::DATE AS run_day,
        count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY user_id, ts::DATE)
SELECT model, arg_max(run_day, run_day) AS run_day, arg_max(n, run_day) AS n,
       arg_max(mean_value, run_day) AS mean_value FROM h GROUP BY model""", "K2 R11 U4")
def q_metrics_history_latest(spark, sf_dir):
    from ..operators.history import latest_per_model
    ev = Tables(spark, sf_dir).events
    h = ev.groupBy("user_id", F.to_date("ts").alias("run_day")).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    h = h.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("model"),
                 "run_day", "n", "mean_value")
    return latest_per_model(h, model="model", ts="run_day")
