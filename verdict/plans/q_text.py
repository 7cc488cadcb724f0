"""Text-job keys: lexical_pair_score (R4), detect_language."""

from __future__ import annotations

from ..operators import langid
from ..operators.lexical import lexical_topk
from ..session import spread
from .registry import Tables, register

_TOK = "regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')"


@register("lexical_pair_score", f"""WITH dtok AS (SELECT DISTINCT doc_id, t FROM (
    SELECT doc_id, unnest({_TOK}) AS t FROM documents) WHERE t <> ''),
idf AS (SELECT t, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM dtok GROUP BY t),
ctok AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TOK}) AS t FROM benchmark) WHERE t <> ''),
sc AS (SELECT c.item_id, d.doc_id, round(sum(i.idf), 6) AS score
       FROM ctok c JOIN dtok d ON d.t = c.t JOIN idf i ON i.t = c.t GROUP BY c.item_id, d.doc_id)
SELECT item_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc)
WHERE rank <= 5""", "R4")
def q_lexical_pair_score(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return lexical_topk(t.benchmark, t.documents, 5, claim_id="item_id", claim_text="text",
                        doc_id="doc_id", doc_text="text")


_CLEAN = "trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_TRI = f"list_transform(range(1, length({_CLEAN}) - 1), lambda i: substr({_CLEAN}, i, 3))"


LANGUAGE_SQL = f"""WITH tc AS (SELECT doc_id, tri, count(*) AS n FROM (
    SELECT doc_id, unnest({_TRI}) AS tri FROM documents) GROUP BY doc_id, tri),
model AS (SELECT tri, d.lang, sum(n) AS c FROM tc JOIN documents d USING (doc_id) GROUP BY tri, d.lang),
tot AS (SELECT lang, ln(sum(c)::DOUBLE + (SELECT count(DISTINCT tri) FROM model)) AS log_den
        FROM model GROUP BY lang),
nd AS (SELECT doc_id, sum(n) AS n_doc FROM tc GROUP BY doc_id),
s AS (SELECT tc.doc_id, m.lang, sum(tc.n * ln(m.c + 1.0)) AS num FROM tc JOIN model m USING (tri)
      GROUP BY tc.doc_id, m.lang),
sc AS (SELECT s.doc_id, s.lang, s.num - nd.n_doc * tot.log_den AS score, nd.n_doc
       FROM s JOIN tot USING (lang) JOIN nd USING (doc_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, lang)
                                      AS rn FROM sc) WHERE rn = 1)
SELECT d.doc_id, coalesce(b.lang, 'unknown') AS lang_pred, round(b.score / b.n_doc, 6) AS score
FROM documents d LEFT JOIN best b USING (doc_id)"""


def detected_languages(t: Tables):
    d = spread(t.documents.select("doc_id", "text", "lang"))
    model, totals = langid.train(d, id_col="doc_id", text_col="text", lang_col="lang")
    return langid.detect(d, model, totals, id_col="doc_id", text_col="text")


@register("detect_language", LANGUAGE_SQL, "R5 A1")
def q_detect_language(spark, sf_dir):
    return detected_languages(Tables(spark, sf_dir))
