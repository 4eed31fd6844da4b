"""Secret scan: candidate strings by pattern, false positives removed by a random forest.

Everything is DataFrame operations and Spark ML in the JVM. A candidate is a run of token characters
with a digit, or what is assigned to a name in :data:`NAMES`; its features are length, transitions between kinds of characters, how much of it is
dictionary words, the path it was found under, and the neighbouring words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.tables import kept, with_row

LEAST_LENGTH = 16
TRAINING_ROWS = 20_000  # the forest is fitted on at most so many distinct labelled findings, half of each label
TREES, DEPTH, SEED = 20, 6, 42
LIKELY = 0.5

# Words that name a credential, and words that mark a value as no secret.
NAMES = "token|secret|passw(or)?d|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential|client[_-]?id"
SAFE = "example|sample|dummy|placeholder|changeme|your|test|xxxx|0000|1234|commit|sha1|sha256|md5|digest|checksum|etag|uuid|guid|version|isbn|card|phone|order|invoice"
LEAST_ASSIGNED = 6  # characters of a value that is assigned to a credential's name
QUOTED_TOKENS = 64  # a quoted value with blanks is taken whole up to so many tokens, else its first token
# An assignment whose value begins in the token after the mark \x01: the operator ends the token before, begins this one, or stands in it.
_NAME, _IS = rf"(?:{NAMES.replace('(or)', '(?:or)')})[\w.-]*[\"'`\])]{{0,3}}", "(?:=>|:=|==?|:)"
_ASSIGN = rf"(?i)(?:{_NAME} ?{_IS}\x01|{_NAME}\x01{_IS}|\x01\S*?{_NAME}{_IS})"
_VALUE = [rf"{q}([^{q}]{{{LEAST_ASSIGNED},}}){q}" for q in "\"'`"] + [rf"[\"'`]?([^\s\"'`]\S{{{LEAST_ASSIGNED - 1},}})"]
# A small dictionary for coverage.
DICTIONARY = (
    "about account address admin after again also and are author base before build cache change class client code "
    "config content count create data date default delete demo document end error event example field file first for "
    "form from function get group hash have header home host html http image index info input item key last level "
    "line link list local log main message method name new next not number object old open order other output page "
    "part path placeholder point post print public query read release report result return right root sample secret "
    "select server service session set simple site size source start state string system table test text that the "
    "this time title token type update user value version view web while window with word work world write your"
).split()

FEATURES = (
    "length", "digits", "uppers", "lowers", "others", "digit_letter", "letter_digit", "case_turns", "repeats",
    "distinct", "hex_only", "digits_only", "dictionary", "quoted", "assigned", "named", "named_near", "safe_near",
    "path_depth", "path_test", "path_digits",
)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(_row, id, path, at, value, before, token, after): one row per candidate.

    ``at`` is the index of the token between blanks, ``before`` the two tokens ahead of it. A candidate is a run of at
    least :data:`LEAST_LENGTH` token characters with a digit, or a value of at least :data:`LEAST_ASSIGNED`
    characters, of any kind, that is assigned to a name in :data:`NAMES`; where both are the same it is one row.
    A null text
    has no candidates; a null path reads as empty; other columns are not read.
    """
    source = with_row(docs.select(F.col(id_col).alias("_id"), F.coalesce(path_col, F.lit("")).alias("path"), F.coalesce(text_col, F.lit("")).alias("_text")))
    split = source.select("_row", "_id", "path", F.split("_text", r"[\s]+").alias("tokens"))
    token = lambda i: F.get("tokens", i)
    near = lambda i, k: F.coalesce(F.when(i + k >= 0, token(i + k)), F.lit(""))
    ahead = lambda i: F.concat_ws(" ", near(i, -2), near(i, -1))
    run = lambda i: (F.length(token(i)) >= LEAST_LENGTH) & token(i).rlike(rf"[A-Za-z0-9+/_\-]{{{LEAST_LENGTH},}}") & token(i).rlike("[0-9]")
    operator = lambda i: token(i).rlike("[=:]") | near(i, -1).rlike("[=:]>?$")
    assigned = lambda i: operator(i) & F.concat(ahead(i), F.lit("\x01"), token(i)).rlike(_ASSIGN)
    wanted = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: run(i) | assigned(i))
    seen = F.transform(
        wanted,
        lambda i: F.struct(
            i.alias("at"), token(i).alias("token"), ahead(i).alias("before"), near(i, 1).alias("after"),
            F.when(assigned(i), F.concat(ahead(i), F.lit("\x01"), F.array_join(F.slice("tokens", i + 1, QUOTED_TOKENS), " "))).alias("line"),
        ),
    )
    each = split.select("_row", "_id", "path", F.explode(seen).alias("s"))
    runs = F.regexp_extract_all("s.token", F.lit(rf"[A-Za-z0-9+/_\-]{{{LEAST_LENGTH},}}"), F.lit(0))
    groups = [F.regexp_extract("s.line", f"{_ASSIGN}(?:{'|'.join(_VALUE)})", k) for k in range(1, 5)]
    given = F.coalesce(*[F.when(g != "", g) for g in groups[:3]], F.regexp_replace(groups[3], "[\"'`]?[,;)\\]}]*$", ""), F.lit(""))
    each = each.withColumns({"given": given, "runs": runs})
    new = (F.length("given") >= LEAST_ASSIGNED) & ~F.array_contains("runs", F.col("given"))
    values = F.when(new, F.concat("runs", F.array("given"))).otherwise(F.col("runs"))
    return (
        each.select("_row", F.col("_id").alias(id_col), "path", "s.at", "given", F.posexplode(values).alias("part", "value"), "s.before", "s.token", "s.after")
        .where(F.col("value").rlike("[0-9]") | (F.col("value") == F.col("given")))
        .drop("given")
    )


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def with_features(found: DataFrame) -> DataFrame:
    v = F.col("value")
    flag = lambda c: c.cast("double")
    around = F.concat_ws(" ", "before", "after")
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    columns = {
        "length": F.length(v).cast("double"),
        "digits": _share(v, "[0-9]"), "uppers": _share(v, "[A-Z]"), "lowers": _share(v, "[a-z]"), "others": _share(v, "[^A-Za-z0-9]"),
        "digit_letter": _share(v, "[0-9](?=[A-Za-z])"), "letter_digit": _share(v, "[A-Za-z](?=[0-9])"),
        "case_turns": _share(v, "[a-z](?=[A-Z])|[A-Z](?=[a-z])"), "repeats": _share(v, r"(.)(?=\1)"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.length(v),
        "hex_only": flag(v.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "digits_only": flag(v.rlike("^[0-9_-]+$")),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(v), words, "")) / F.length(v),
        "quoted": flag(F.col("token").rlike("[\"'`]")), "assigned": flag(F.col("token").rlike("[=:]") | F.col("before").rlike("[=:]\\s*$")),
        "named": flag(F.col("token").rlike(f"(?i)({NAMES})")), "named_near": flag(F.col("before").rlike(f"(?i)({NAMES})")),
        "safe_near": flag(around.rlike(f"(?i)({SAFE})") | v.rlike(f"(?i)({SAFE})")),
        "path_depth": F.regexp_count("path", F.lit("/")).cast("double"), "path_test": flag(F.col("path").rlike("(?i)test|example|sample|docs?/")),
        "path_digits": _share(F.concat(F.col("path"), F.lit(" ")), "[0-9]"),
    }
    return found.withColumns(columns)


def with_label(found: DataFrame) -> DataFrame:
    """All findings with ``label``, null where the case is not plain.

    A mixed value assigned to a credential's name is a secret; plain numbers, values beside a word that
    marks them as harmless and values under no name that are mostly words are not; nor is a
    value without digits that is mostly words, whatever its name. Other findings get no label.
    """
    mixed = (F.col("digits_only") == 0) & (F.col("digits") > 0) & (F.col("distinct") * F.col("length") >= 8) & (F.col("dictionary") < 0.5)
    name = (F.col("named") + F.col("named_near") > 0) & (F.col("assigned") > 0)
    secret = name & mixed & (F.col("safe_near") == 0)
    words = (F.col("digits") == 0) & (F.col("dictionary") >= 0.5)
    harmless = (F.col("digits_only") > 0) | words | (F.col("safe_near") > 0) | (~name & (F.col("dictionary") >= 0.5)) | (~name & (F.col("distinct") * F.col("length") < 8))
    label = F.when(secret, 1.0).when(harmless, 0.0)
    return found.withColumn("label", label)


def labelled(found: DataFrame) -> DataFrame:
    """Findings whose case is plain, by :func:`with_label`: the training set where no reviewed findings are given."""
    return with_label(found).where("label is not null")


def sample(examples: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """(features, label): of the distinct examples at most ``rows`` / 2 of each label, by hash order.

    Copies of one (value, before, after, path) under one label count once. Every label that occurs is in
    the sample, however rare.
    """
    key = ["value", "before", "after", "path"]
    distinct = kept(
        examples.groupBy(*key, "label").agg(F.min(F.struct(*FEATURES)).alias("f")).select(F.xxhash64(*key).alias("_o"), "label", "f.*")
    )
    labels = [r.label for r in distinct.select("label").distinct().orderBy("label").collect()]
    parts = [distinct.where(F.col("label") == label).orderBy("_o", *FEATURES).limit(max(rows // 2, 1)) for label in labels]
    return kept(reduce(DataFrame.unionByName, parts)) if parts else distinct


def train(examples: DataFrame, rows: int = TRAINING_ROWS) -> PipelineModel | None:
    """A forest over (features, label) of a :func:`sample`; None where all examples together have one label only."""
    bounded = sample(examples, rows)
    if len(bounded.select("label").distinct().take(2)) < 2:
        return None
    features = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features")
    return PipelineModel([features, forest.fit(features.transform(bounded))])


def scan_secrets(docs: DataFrame, examples: DataFrame | None = None, **options) -> DataFrame:
    """Every finding with ``score`` and ``secret``: (id, path, at, part, value, before, after, score, secret).

    ``examples`` are reviewed findings (:data:`FEATURES`, value, before, after, path, label); without them
    :func:`labelled` gives the plain cases. Where these have one label only there is nothing to learn and a
    finding scores by its own :func:`with_label` (no label: 0). An empty table gives no rows.
    """
    found = kept(with_features(findings(docs, **options)))
    model = train(labelled(found) if examples is None else examples)
    if model is None:
        scored = with_label(found).withColumn("score", F.coalesce("label", F.lit(0.0)))
    else:
        scored = model.transform(found).withColumn("score", vector_to_array("probability")[1])
    id_col = options.get("id_col", "doc_id")
    return scored.select(
        id_col, "path", "at", "part", "value", "before", "after", F.round("score", 6).alias("score"), (F.col("score") >= LIKELY).alias("secret")
    )
