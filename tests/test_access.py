from pyspark.sql import functions as F

from quillspark.operators import acl as A

WHO = "principal_id long, user_id long, role string, department_path string"
GRANTS = "document_id long, subject_kind string, subject string"


def test_granted_documents_equal_brute_force(spark):
    who = [(1, 1, "manager", "c.eng"), (2, 2, "guest", "c.eng.web"), (3, 3, "manager", None), (3, 4, None, "c.hr"), (5, 5, None, None)]
    grants = [(i, "role", "manager") for i in range(5001)] + [(1, "user", "1"), (7000, "user", "1"), (7000, "user", "5"), (3, "path", "c.eng"), (7001, "path", "c.eng"), (7001, "path", "c.eng"), (7002, "path", "c"), (7003, "user", None)]
    for inherit in (False, True):
        want = set()
        for p, user, role, path in who:
            up = {".".join(path.split(".")[: i + 1]) for i in range(path.count(".") + 1)} if path and inherit else {path}
            want |= {(p, d) for d, kind, subject in grants if subject is not None and ((kind == "role" and subject == role) or (kind == "user" and subject == str(user)) or (kind == "path" and subject in up))}
        n = {p: sum(q == p for q, _ in want) > A.MOST_GRANTS for p, _ in want}
        got = A.granted_documents(spark.createDataFrame(grants, GRANTS), spark.createDataFrame(who, WHO), inherit).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == {(p, d, n[p]) for p, d in want}


def test_pairs_of_grants_are_neither_shuffled_nor_counted(spark):
    who, grants = spark.createDataFrame([(1, 1, "manager", "c")], WHO), spark.createDataFrame([(1, "role", "manager")], GRANTS)
    plan = A.granted_documents(grants, who).select("principal_id", "document_id", F.col("over"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_documents") < plan.index("Aggregate")


def test_written_pairs_of_grants_are_small(spark, tmp_path):
    # more documents than rows of a page, so that whole lists of documents do not come again within one
    who = spark.range(300).select(F.col("id").alias("principal_id"), F.col("id").alias("user_id"), F.lit("manager").alias("role"), F.lit("c").alias("department_path"))
    grants = spark.range(21_000).select((F.col("id") * 7).alias("document_id"), F.lit("role").alias("subject_kind"), F.lit("manager").alias("subject"))
    A.granted_documents(grants, who).write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs").agg(F.count(F.lit(1)), F.count_distinct("principal_id"), F.count_distinct("document_id"), F.min("over")).first()
    assert tuple(got) == (300 * 21_000, 300, 21_000, True)
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert size < 300 * 21_000 / 2
