"""Registered queries of filters and access control."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table, with_sql
from ..functions import filters as L
from ..operators import acl as A

NOW, TODAY = 1.7e9, "2025-03-01"


def _ids(condition):
    def run(s, d):
        docs = table(s, d, "doc_meta")
        return docs.filter(condition.column(docs.schema)).select("document_id")

    return run


def _principals(s, d):
    p = table(s, d, "principals")
    return p.withColumn("principal_id", F.concat_ws("/", "role", "mode", F.coalesce("department_path", F.lit("-"))))


def _users(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select(
        F.col("c_custkey").alias("user_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("guest", "customer", "internal_employee", "manager", "admin")]), (F.col("c_custkey") % 5 + 1).cast("int")).alias("role"),
        F.when(F.col("c_custkey") % 2 == 0, "internal").otherwise("customer").alias("mode"),
        F.when(F.col("c_custkey") % 3 == 0, "company.eng").otherwise("company.hr").alias("department_path"),
    )


def _grants(s, d):
    docs = table(s, d, "doc_meta").filter("document_id % 7 = 0")
    kind = F.element_at(F.array(F.lit("role"), F.lit("user"), F.lit("path")), (F.col("document_id") % 3 + 1).cast("int"))
    subject = F.when(kind == "role", "manager").when(kind == "user", (F.col("document_id") % 50).cast("string")).otherwise("company.eng")
    return docs.select("document_id", kind.alias("subject_kind"), subject.alias("subject"))


def _overrides(s, d):
    u = _users(s, d)
    return u.filter("user_id % 4 = 0").select("user_id", F.when(F.col("user_id") % 8 == 0, "deny").otherwise("allow").alias("effect"), F.when(F.col("user_id") % 3 == 0, "read").otherwise("audit").alias("permission"))


def _role_grants(s, d):
    return _users(s, d).select("user_id", F.explode(F.when(F.col("role") == "admin", F.array(F.lit("read"), F.lit("audit"))).otherwise(F.array(F.lit("read")))).alias("permission"))


def _matrix(s, d):
    return A.acl_join(table(s, d, "doc_meta"), _principals(s, d), NOW).select("principal_id", "document_id")


def _matrix_grants(s, d):
    """Every principal holds every 97th document as a grant."""
    return table(s, d, "doc_meta").filter("document_id % 97 = 0").select("document_id", F.explode(F.lit(["guest", "customer", "internal_employee", "manager", "admin"])).alias("role")).join(_principals(s, d).select("role", "principal_id"), "role").select("principal_id", "document_id")


def _expected(s, d, broken=False):
    """Readable pairs by the rule of levels as SQL cases, written apart from the operator; broken: without departments."""
    ceiling = "CASE p.role WHEN 'guest' THEN IF(p.mode = 'customer', 0, -1) WHEN 'customer' THEN IF(p.mode = 'customer', 1, -1) ELSE IF(p.mode = 'customer', 1, CASE p.role WHEN 'internal_employee' THEN 2 WHEN 'manager' THEN 3 ELSE 4 END) END"
    within = "true" if broken else "d.document_id % 97 = 0 OR d.visibility_level <> 3 OR coalesce(d.department_path = p.department_path OR startswith(d.department_path, concat(p.department_path, '.')), false)"
    return s.sql(f"SELECT p.principal_id, d.document_id FROM {{docs}} d JOIN {{who}} p ON d.mode = p.mode WHERE d.is_active AND (d.expires_epoch IS NULL OR d.expires_epoch > {NOW}) AND d.visibility_level <= {ceiling} AND ({within})", docs=table(s, d, "doc_meta"), who=_principals(s, d))


QUERIES = {
    "acl11_roots": lambda s, d: A.in_subtree_of_any(table(s, d, "doc_meta").select("document_id", "department_path"), table(s, d, "doc_meta").select(F.col("department_path").alias("root")).distinct()).select("document_id", "root"),
    "evl8_equal": lambda s, d: A.matrix_difference(table(s, d, "doc_meta"), _principals(s, d), _expected(s, d), _matrix_grants(s, d), NOW),
    "evl8_broken": lambda s, d: A.matrix_difference(table(s, d, "doc_meta"), _principals(s, d), _expected(s, d, broken=True), _matrix_grants(s, d), NOW),
    "flt1_match": _ids(L.Match("tags", "src3")),
    "flt2_in": _ids(L.In("collection_id", (1, 3))),
    "flt3_range": _ids(L.Range("visibility_level", gte=1, lt=3)),
    "flt4_prefix": _ids(L.PrefixMatch("department_path", "company.hr")),
    "flt5_null": _ids(L.IsNull("expires_epoch")),
    "flt6_any": _ids(L.HasAny("tags", ("de", "src1"))),
    "flt7_nested": _ids(L.Or((L.And((L.Match("mode", "customer"), L.Range("n_chars", gt=2000))), L.Match("owner_id", 3)))),
    "flt8_group": _ids(L.VectorFilter(must=(L.Match("is_active", True),), must_not=(L.Range("expires_epoch", lt=NOW),), should=(L.Match("lang", "fr"), L.Range("n_chars", lt=1000), L.Match("mode", "customer")), min_should=2)),
    "flt9_ancestors": lambda s, d: table(s, d, "doc_meta").select("document_id", F.array_join(L.ancestor_paths(F.col("department_path")), "|").alias("ancestors")),
    "flt10_payload": lambda s, d: table(s, d, "doc_meta").select("document_id", L.to_epoch(F.col("created_on")).alias("created_epoch"), F.col("mode"), F.size(L.ancestor_paths(F.col("department_path"))).cast("long").alias("depth")),
    "acl1_ceiling": lambda s, d: A.resolve_ceiling(_users(s, d)).select("user_id", "ceiling", "denied"),
    "acl2_join": _matrix,
    "acl2_filter": lambda s, d: (lambda docs: docs.filter(A.acl_filter("internal", 3, "company.eng", (97, 194, 291), NOW).column(docs.schema)).select("document_id"))(table(s, d, "doc_meta")),
    "acl3_verify": lambda s, d: A.verify_readable(table(s, d, "points"), table(s, d, "doc_meta"), 3, "company.eng", "internal", TODAY).select("chunk_id", "document_id"),
    "acl4_can_read": lambda s, d: A.can_read_document(table(s, d, "doc_meta"), 2, "company.hr", "internal", F.col("document_id") % 97 == 0).select("document_id", "can_read"),
    "acl5_retrievable": lambda s, d: A.retrievable(table(s, d, "doc_meta"), TODAY).select("document_id"),
    "acl6_granted": lambda s, d: A.granted_documents(_grants(s, d), _users(s, d).withColumn("principal_id", F.col("user_id"))).select("principal_id", "document_id", "over"),
    "acl7_readers": lambda s, d: A.effective_reader_count(table(s, d, "doc_meta"), _users(s, d)),
    "acl8_labels": lambda s, d: table(s, d, "doc_meta").select("document_id", A.visibility_label(F.col("visibility_level")).alias("label"), A.visibility_level(F.upper(A.visibility_label(F.col("visibility_level")))).alias("level")),
    "acl9_permissions": lambda s, d: A.resolve_permissions(_role_grants(s, d), _overrides(s, d)),
    "acl10_propagate": lambda s, d: A.propagate_acl(table(s, d, "points").withColumns({"visibility_level": F.col("chunk_id") % 5, "department_path": F.lit("company.hr")}), table(s, d, "doc_meta")).select("chunk_id", "visibility_level", "department_path", "changed"),
    "acl11_subtree": lambda s, d: A.subtree(table(s, d, "departments"), "company.asia").select("path", "id"),
}

D = with_sql("doc_meta")
_USERS = """users AS (SELECT c_custkey AS user_id, CASE c_custkey % 5 WHEN 0 THEN 'guest' WHEN 1 THEN 'customer' WHEN 2 THEN 'internal_employee' WHEN 3 THEN 'manager' ELSE 'admin' END AS role,
 CASE WHEN c_custkey % 2 = 0 THEN 'internal' ELSE 'customer' END AS mode, CASE WHEN c_custkey % 3 = 0 THEN 'company.eng' ELSE 'company.hr' END AS department_path FROM customer)"""
_CEIL = "ceil AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{m}', {c})" for r, m, c in A.CEILINGS) + ") t(role, mode, ceiling))"
_SUB = "(department_path = '{0}' OR starts_with(department_path, '{0}.'))"

_PAIRS = with_sql("principals", "doc_meta").rstrip() + """, w AS (SELECT role || '/' || mode || '/' || coalesce(department_path, '-') AS principal_id, mode AS m, department_path AS p, CASE WHEN mode = 'customer' THEN CASE role WHEN 'guest' THEN 0 ELSE 1 END ELSE CASE role WHEN 'internal_employee' THEN 2 WHEN 'manager' THEN 3 WHEN 'admin' THEN 4 ELSE -1 END END AS ceiling FROM principals),
j AS (SELECT principal_id, document_id, visibility_level, visibility_level = 3 AND document_id % 97 <> 0 AND NOT coalesce(department_path = p OR starts_with(department_path, p || '.'), false) AS walled FROM doc_meta JOIN w ON mode = m WHERE is_active AND (expires_epoch IS NULL OR expires_epoch > 1.7e9) AND visibility_level <= ceiling)"""
ORACLES = {
    "acl11_roots": with_sql("doc_meta") + ", r AS (SELECT DISTINCT department_path AS root FROM doc_meta) SELECT document_id, root FROM doc_meta JOIN r ON department_path = root OR starts_with(department_path, root || '.')",
    "evl8_equal": _PAIRS + " SELECT principal_id, 'missing' AS side, visibility_level, count(*) AS n, min(document_id) AS witness FROM j WHERE false GROUP BY 1, 2, 3",
    "evl8_broken": _PAIRS + " SELECT principal_id, 'missing' AS side, visibility_level, count(*) AS n, min(document_id) AS witness FROM j WHERE walled GROUP BY 1, 2, 3",
    "flt1_match": D + "SELECT document_id FROM doc_meta WHERE list_contains(tags, 'src3')",
    "flt2_in": D + "SELECT document_id FROM doc_meta WHERE collection_id IN (1, 3)",
    "flt3_range": D + "SELECT document_id FROM doc_meta WHERE visibility_level >= 1 AND visibility_level < 3",
    "flt4_prefix": D + "SELECT document_id FROM doc_meta WHERE department_path = 'company.hr' OR starts_with(department_path, 'company.hr.')",
    "flt5_null": D + "SELECT document_id FROM doc_meta WHERE expires_epoch IS NULL",
    "flt6_any": D + "SELECT document_id FROM doc_meta WHERE source = 'src1' OR lang = 'de'",
    "flt7_nested": D + "SELECT document_id FROM doc_meta WHERE (mode = 'customer' AND n_chars > 2000) OR owner_id = 3",
    "flt8_group": D + f"SELECT document_id FROM doc_meta WHERE is_active AND NOT coalesce(expires_epoch < {NOW}, false) AND (lang = 'fr')::INT + (n_chars < 1000)::INT + (mode = 'customer')::INT >= 2",
    "flt9_ancestors": D + "SELECT document_id, CASE department_path WHEN 'company.eng.platform' THEN 'company|company.eng|company.eng.platform' ELSE 'company|' || department_path END AS ancestors FROM doc_meta",
    "flt10_payload": D + "SELECT document_id, epoch(created_on)::DOUBLE AS created_epoch, mode, len(string_split(department_path, '.')) AS depth FROM doc_meta",
    "acl1_ceiling": f"WITH {_USERS}, {_CEIL} SELECT user_id, ceiling, ceiling IS NULL AS denied FROM users LEFT JOIN ceil USING (role, mode)",
    "acl2_join": with_sql("principals", "doc_meta").rstrip() + f""", {_CEIL}, w AS (SELECT role || '/' || mode || '/' || coalesce(department_path, '-') AS principal_id, mode, ceiling, department_path AS p FROM principals JOIN ceil USING (role, mode))
 SELECT principal_id, document_id FROM doc_meta d JOIN w ON d.mode = w.mode AND visibility_level <= ceiling AND is_active AND (expires_epoch IS NULL OR expires_epoch > {NOW})
 AND (visibility_level <= least(ceiling, 2) OR (visibility_level = 3 AND (department_path = p OR starts_with(department_path, p || '.'))) OR (visibility_level = 4 AND ceiling >= 4))""",
    "acl2_filter": D + f"SELECT document_id FROM doc_meta WHERE mode = 'internal' AND is_active AND visibility_level <= 3 AND (expires_epoch IS NULL OR expires_epoch > {NOW}) AND (visibility_level <= 2 OR (visibility_level = 3 AND {_SUB.format('company.eng')}) OR document_id IN (97, 194, 291))",
    "acl3_verify": with_sql("doc_meta", "points") + f"SELECT chunk_id, p.document_id FROM points p JOIN doc_meta d USING (document_id) WHERE visibility_level <= 3 AND NOT is_archived AND mode = 'internal' AND (expires_epoch IS NULL OR expires_epoch > epoch(DATE '{TODAY}')) AND created_on <= DATE '{TODAY}' AND (visibility_level <= 2 OR (visibility_level = 3 AND {_SUB.format('company.eng')}))",
    "acl4_can_read": D + f"SELECT document_id, CASE WHEN mode <> 'internal' THEN false WHEN document_id % 97 = 0 THEN true WHEN visibility_level > 2 THEN false ELSE true END AS can_read FROM doc_meta",
    "acl5_retrievable": D + f"SELECT document_id FROM doc_meta WHERE NOT is_archived AND is_active AND created_on <= DATE '{TODAY}' AND (expires_epoch IS NULL OR expires_epoch > epoch(DATE '{TODAY}'))",
    "acl6_granted": D.rstrip() + f""", {_USERS}, g AS (SELECT document_id, CASE document_id % 3 WHEN 0 THEN 'role' WHEN 1 THEN 'user' ELSE 'path' END AS k, CASE document_id % 3 WHEN 0 THEN 'manager' WHEN 1 THEN (document_id % 50)::VARCHAR ELSE 'company.eng' END AS v FROM doc_meta WHERE document_id % 7 = 0),
 o AS (SELECT DISTINCT user_id AS principal_id, document_id FROM users JOIN g ON (k = 'role' AND v = role) OR (k = 'user' AND v = user_id::VARCHAR) OR (k = 'path' AND v = department_path))
 SELECT principal_id, document_id, count(*) OVER (PARTITION BY principal_id) > 5000 AS over FROM o""",
    "acl7_readers": D.rstrip() + f""", {_USERS}, {_CEIL}, w AS (SELECT mode AS m, ceiling, department_path AS p, count(*) AS n FROM users JOIN ceil USING (role, mode) GROUP BY ALL)
 SELECT document_id, coalesce(sum(n), 0)::BIGINT AS readers FROM doc_meta LEFT JOIN w ON mode = m AND visibility_level <= ceiling AND (visibility_level <> 3 OR department_path = p OR starts_with(department_path, p || '.')) GROUP BY 1""",
    "acl8_labels": D + "SELECT document_id, ['public','customer','internal','confidential','restricted'][visibility_level + 1] AS label, visibility_level::INT AS level FROM doc_meta",
    "acl9_permissions": f"""WITH {_USERS}, o AS (SELECT user_id, CASE WHEN user_id % 8 = 0 THEN 'deny' ELSE 'allow' END AS effect, CASE WHEN user_id % 3 = 0 THEN 'read' ELSE 'audit' END AS permission FROM users WHERE user_id % 4 = 0),
 a AS (SELECT user_id, 'read' AS permission FROM users UNION SELECT user_id, 'audit' FROM users WHERE role = 'admin' UNION SELECT user_id, permission FROM o WHERE effect = 'allow')
 SELECT user_id, permission FROM a EXCEPT SELECT user_id, permission FROM o WHERE effect = 'deny'""",
    "acl10_propagate": with_sql("doc_meta", "points") + "SELECT chunk_id, d.visibility_level, d.department_path, NOT (p.chunk_id % 5 = d.visibility_level AND d.department_path = 'company.hr') AS changed FROM points p JOIN doc_meta d USING (document_id)",
    "acl11_subtree": with_sql("departments") + "SELECT path, id FROM departments WHERE path = 'company.asia' OR starts_with(path, 'company.asia.')",
}
