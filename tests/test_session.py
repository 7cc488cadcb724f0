"""Session helpers: checkpoint folder resolution, lineage cuts, spreading."""

from pyspark.sql import functions as F

from verdict.operators.prep import PROMPTS, attach_paths, complete_modality
from verdict.operators.votes import claim_verdict, majority_vote, two_level_verdict
from verdict.session import build_session, checkpoint_dir, cut_lineage, spread


def test_checkpoint_dir_and_cut(spark):
    d = checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir()
    df = cut_lineage(spark.range(10).withColumnRenamed("id", "x"))
    assert df.count() == 10
    assert "LogicalRDD" in df._jdf.queryExecution().analyzed().toString()  # lineage cut


def test_spread_only_when_needed(spark):
    par = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == par
    many = spark.range(0, 100, numPartitions=par * 2)
    assert spread(many).rdd.getNumPartitions() == par * 2


def test_launcher_settings_are_kept(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert build_session().conf.get("spark.sql.shuffle.partitions") == before


def test_every_claim_gets_a_verdict(spark):
    evidence = spark.createDataFrame([(1, 1, "support"), (1, 2, "support")], "claim long, pos int, v string")
    claims = spark.range(12).select(F.col("id").alias("claim"))
    rows = {r.claim: r for r in claim_verdict(evidence, claim="claim", position="pos", verdict="v", claims=claims).collect()}
    assert len(rows) == 12 and (rows[1].verdict, rows[1].n_support) == ("support", 2)
    assert (rows[5].verdict, rows[5].n_support, rows[5].contributing) == ("not_enough_information", 0, "")


def test_votes_keep_claims_without_answers(spark):
    answers = spark.createDataFrame([(1, "yes", 0.5), (2, "NEI", 0.5), (3, "yes", 0.5)], "claim long, label string, score double")
    level2 = spark.createDataFrame([(1, "refuted", 0.5)], "claim long, label string, score double")
    claims = spark.range(5).select(F.col("id").alias("claim"))
    args = {"claim": "claim", "label": "label", "score": "score", "claims": claims}
    rows = {r.claim: r for r in majority_vote(answers, **args).collect()}
    assert len(rows) == 5 and (rows[0].final_label, rows[0].votes, rows[0].max_score) == ("NEI", 0, None)
    rows = {r.claim: (r.final_label, r.level) for r in two_level_verdict(answers, level2, **args).collect()}
    assert rows == {0: ("NEI", 1), 1: ("refuted", 2), 2: ("NEI", 1), 3: ("NEI", 2), 4: ("NEI", 1)}


def test_attached_paths_keep_the_original_columns(spark):
    claims = spark.createDataFrame([(1, "http://a", "http://b")], "id long, claim_image string, evidence_image string")
    listing = spark.createDataFrame([("images/1_claim.jpg",), ("images/1_evidence.jpg",)], "path string")
    r = complete_modality(attach_paths(claims, listing)).collect()
    assert [(x.claim_image_original, x.claim_image, x.evidence_image) for x in r] == [
        ("http://a", "images/1_claim.jpg", "images/1_evidence.jpg")]


def test_text_query_prompt():
    assert PROMPTS["text_query"].replace("{question}", "Q").replace("{claim}", "C") == "Q\n text query:C"
