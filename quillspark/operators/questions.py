"""Question understanding over conversation turns: intents, variants, history, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# The patterns of intents, in the order in which they are tried.
GREETING = r"(?i)^\s*(hi|hey|hello|good\s+(morning|afternoon|evening)|thanks?|thank\s+you|bye|goodbye|ok(ay)?|cool|great|nice)\b[\s!.?]*$"
FEEDBACK = r"(?i)^\s*(that('s| is)?\s+(wrong|incorrect|helpful|great|perfect)|not\s+what\s+i\s+asked)"
FOLLOWUP = r"(?i)^\s*(and |but |what about|how about|why( not)?\??$|really\??$|(what|who|when|where|which|how)\b[^?]{0,40}\b(it|its|they|them|their|that|those|this|these|he|she)\b)"
COMPARISON = r"(?i)\b(vs\.?|versus|compare[ds]?|difference between|better than)\b"
SUMMARY = r"(?i)\b(summar(y|ise|ize)|overview|tl;?dr|key points|in short)\b"
AGGREGATION = r"(?i)\b(how many|how much|count|total|average|list all|all of the)\b"
PROCEDURAL = r"(?i)\b(how (do|can|to)|steps?|process|procedure|walk me through|set ?up|configure)\b"
PRONOUN = r"(?i)\b(it|its|they|them|their|that|those|this|these|the same|there)\b"
NO_RETRIEVAL = ("greeting", "feedback", "out_of_scope", "unsafe")


def classify_intent(question: Column, has_history: Column) -> Column:
    t = X.strip(F.coalesce(question, F.lit("")))
    return (
        F.when((t == "") | t.rlike(GREETING), "greeting")
        .when(t.rlike(FEEDBACK), "feedback")
        .when(has_history & t.rlike(FOLLOWUP), "followup")
        .when(t.rlike(COMPARISON), "comparison")
        .when(t.rlike(SUMMARY), "summarization")
        .when(t.rlike(AGGREGATION), "aggregation")
        .when(t.rlike(PROCEDURAL), "procedural")
        .otherwise("factual_lookup")
    )


def needs_retrieval(intent: Column) -> Column:
    return ~intent.isin(*NO_RETRIEVAL)


def _turns() -> Window:
    return Window.partitionBy("conv_id").orderBy("turn")


def preceding_question(turns: DataFrame) -> DataFrame:
    """turns with the user text before each (a backward as-of join, as a window)."""
    before = _turns().rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("question", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before))


def plan_queries(turns: DataFrame) -> DataFrame:
    """User turns with intent and the texts to search: the question, and, where it refers back, the last question
    before it (200 characters) and itself."""
    known = preceding_question(turns).withColumn("has_history", F.row_number().over(_turns()) > 1).filter("role = 'user'")
    out = known.withColumn("intent", classify_intent(F.col("text"), F.col("has_history")))
    stitched = F.when(((F.col("intent") == "followup") | F.col("text").rlike(PRONOUN)) & (F.col("question") != ""), F.concat(F.substring(X.strip(F.col("question")), 1, 200), F.lit(" "), F.col("text")))
    return out.withColumn("queries", F.when(needs_retrieval(F.col("intent")), F.array_compact(F.array(F.col("text"), stitched))).otherwise(F.array().cast("array<string>")))


def query_keywords(c: Column, most: int = 6) -> Column:
    """The first distinct identifier-like words that are no function words."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z0-9][A-Za-z0-9._\-/]{1,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda w: ~F.lower(w).isin(*X.QUERY_STOPWORDS))), 1, most)


def parse_plan(reply: Column) -> Column:
    """(intent, queries, keywords) from the outermost braces of a reply; null where they hold no such object."""
    return F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "intent string, queries array<string>, keywords array<string>")


def recent_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """turns with the up to n user and assistant turns before each, oldest first."""
    said = F.when(F.col("role").isin("user", "assistant"), F.struct("turn", "role", "text"))
    return turns.filter(F.col("role").isin("user", "assistant")).withColumn("history", F.collect_list(said).over(_turns().rowsBetween(-n, -1)))


def quick_title(turns: DataFrame, most: int = 60) -> DataFrame:
    """A conversation's title from its first question: white space single, cut at a word, with an ellipsis."""
    first = turns.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    t = F.trim(F.regexp_replace("t", r"\s+", " "))
    cut = F.regexp_extract(F.substring(t, 1, most), r"^(.*) \S*$", 1)
    return first.select("conv_id", F.when(F.length(t) <= most, t).otherwise(F.concat(F.when(cut == "", F.substring(t, 1, most)).otherwise(cut), F.lit("…"))).alias("title"))


def allocate_budget(turns: DataFrame) -> DataFrame:
    """Per conversation the token allowances of its last question: question, history, context."""
    tokens = X.token_count(F.col("text"))
    rows = turns.withColumn("tokens", tokens).groupBy("conv_id").agg(F.max_by("tokens", "turn").alias("q"), (F.sum("tokens") - F.max_by("tokens", "turn")).alias("h"))
    question, history = F.least(F.greatest("q", F.lit(1)), F.lit(1200)), F.least("h", F.lit(2000))
    return rows.select("conv_id", question.alias("question"), history.alias("history"), F.least(F.lit(10_000), F.greatest(F.lit(0), 16_000 - 2_000 - 900 - 200 - question - history)).alias("context"))


def history_fit(turns: DataFrame, budget: int = 2000, most: int = 6) -> DataFrame:
    """Per conversation how many of the newest turns fit a budget."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= most).withColumn("used", F.sum(X.token_count(F.col("text"))).over(newest))
    return rows.groupBy("conv_id").agg(F.count_if(F.col("used") <= budget).alias("turns"))


def needs_summary(turns: DataFrame, threshold: int = 8) -> DataFrame:
    return turns.groupBy("conv_id").agg((F.count(F.lit(1)) > threshold).alias("due"))


def guard_input(turns: DataFrame, most: int = 4000, sure: float = 0.8) -> DataFrame:
    """turns with a verdict: blocked (empty, too long, or surely injected), suspicious, or allowed."""
    found = F.array_max(F.transform(X.injection_scan(F.col("text")), lambda f: f["confidence"]))
    t = X.strip(F.coalesce(F.col("text"), F.lit("")))
    reason = F.when(t == "", "empty").when(F.length(t) > most, "too_long").when(found >= sure, "injection")
    return turns.withColumn("reason", reason).withColumn("verdict", F.when(F.col("reason").isNotNull(), "blocked").when(found.isNotNull(), "suspicious").otherwise("allowed"))


# What gives away a system prompt, and words an answer to customers shouldn't use.
LEAKS = (r"<<<SOURCE\s+\d+>>>", r"(?m)^\s*##\s*(Grounding|Citations|Untrusted content)\b", r"(?i)\byou are a document-grounded assistant\b")
TELLS = r"(?i)\b(internal[- ]only|confidential document|restricted document|employee[- ]only|internal knowledge base|you are not authori[sz]ed)\b"


def guard_output(turns: DataFrame) -> DataFrame:
    """Assistant turns with secrets redacted, and whether they leak a prompt or name internal matters."""
    leak = F.lit(False)
    for p in LEAKS:
        leak = leak | F.col("text").rlike(p)
    return turns.filter("role = 'assistant'").withColumns({"leak": leak, "tells": F.col("text").rlike(TELLS), "clean": X.redact(F.col("text"))})
