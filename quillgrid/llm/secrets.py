"""Secret scan: candidate strings and a random forest that removes false positives.

Only DataFrame functions and the JVM's forest are used.  Candidates are long runs of key-like
characters, and values assigned to telling names.  The forest looks at length, character transitions, dictionary coverage, path marks
and neighbouring words.  It is trained on labelled findings of two kinds: candidates of a bounded sample of texts that a provider's format
or an assignment marks as secrets, or that are long words, plain numbers and named checksums; and findings planted in the sample's texts,
whose label is known because they were made as keys, passwords, checksums, identifiers, paths and addresses.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, save, table

#: Formats of well-known providers (fixed values).
PROVIDERS = (
    "^(A[KS]IA[0-9A-Z]{16}|gh[opsur]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{60,}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{20,}"
    "|[prs]k_(live|test)_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|SG_[A-Za-z0-9_-]{40,}|eyJ[A-Za-z0-9_-]{30,})$"
)
TELLING = "secret|token|passwo?r?d?|pwd|api[_ -]?key|auth|credential|access[_ -]?key|private[_ -]?key|bearer"
BENIGN = "commit|sha-?1|sha-?256|md5|checksum|uuid|guid|digest|revision|etag|hash|integrity|build|version"
ASSIGNED = rf"({TELLING})[A-Za-z0-9_]*[\"']?\s*(=|:|=>|:=)\s*[\"']?$"
_RUN = "[A-Za-z0-9_+/-]"
#: A run of 16 characters or more with a digit, or with a capital inside, and with a letter.
MIXED_RUN = rf"(?<!{_RUN})(?=[A-Za-z_+/-]*+[0-9]|[A-Z0-9_+/-]*+[a-z]++[A-Z])(?=[0-9_+/-]*+[A-Za-z]){_RUN}{{16,}}+"
#: Any run so long, for training.
LONG_RUN = rf"(?<!{_RUN}){_RUN}{{16,}}+"


def _value() -> str:
    """The value of an assignment to a telling name: six characters or more, within quotes or up to white space.

    Java bounds what a lookbehind reads, so a name ends 32 characters after its telling word and 8 blanks stand on each side of the sign
    (63 characters together, all within CONTEXT).  Without quotes, closing signs at the end and a next named value (``,user=``) stay outside.
    Quoted sentences with a long mixed run are left to that run, and so are addresses without a user.
    """
    at = rf"(?<=[=:>\s\"'])(?<=[=:>]\s{{0,8}}[\"']?)(?<=(?i:{TELLING})[A-Za-z0-9_]{{0,32}}[\"']?\s{{0,8}}(?:=>|:=|=|:)\s{{0,8}}[\"']?)(?!(?<=:)=|(?<==)>)(?!\s)"
    ends, following = r",;.)\]}>\"'", r"(?![,;&|][\"']?[A-Za-z_][A-Za-z0-9_.-]{0,31}[\"']?[=:])"
    closing, inner = rf"(?:{following}[{ends}])*+", rf"{following}[^\s{ends}]"
    bare = rf"(?!https?://[^\s@]*+(?:\s|$))(?=(?:{following}\S){{5}}{closing}{inner})(?:{closing}{inner})++"
    quoted = []
    for q in "\"'":
        line = rf"[^{q}\p{{Cntrl}}]"
        whole = rf"(?!https?://[^\s{q}@]*+{q})(?!(?={line}*?\s){line}*?{MIXED_RUN})(?:\\.|[^{q}\\\p{{Cntrl}}]){{6,}}+(?={q})"
        quoted.append(rf"(?<={q})(?:{whole}|(?!{line}*+{q}){bare})")
    return rf"{at}(?:{'|'.join(quoted)}|(?<![\"'])(?![\"']){bare})"


VALUE = _value()
#: Both forms of candidates; a value begins where a run begins, and holds it whole.
CANDIDATE = f"{VALUE}|{MIXED_RUN}"
#: What a text with a candidate has in any case; quicker to look for.
MARK = f"{_RUN}{{16}}|(?i:{TELLING})"
#: What training looks at.
BROAD = f"{VALUE}|{LONG_RUN}"
WORDY = "^[A-Z]?[a-z]+$|^[A-Z]+$"
#: Values that stand for others: expressions, places to fill in, addresses.
REFERENCE = r"^[$<{\[(%]|[A-Za-z_](\(.*\)|\[\w*\])|^(?:self|this|os|process|env|config|settings)\.|^[*x.]+$|^https?://[^@]*$"
#: Mean log likelihood of letter pairs below which letters are not words.
UNLIKE = -4.0
CONTEXT = 64
#: Documents (about) and characters each that the labelled findings come from, and findings at most.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_FINDINGS = 2000, 20_000, 20_000
#: Planted findings for each sampled text.
PLANTS = 4
DICTIONARY = 2000
TREES, DEPTH, THRESHOLD = 20, 6, 0.5
FEATURES = (
    "length", "digit_share", "upper_share", "distinct_share", "class_runs", "hex_only", "likelihood", "coverage",
    "slashes", "path_before", "telling", "benign", "quoted",
)
MASK = "[SECRET]"


@dataclass
class Statistics:
    """Letter-pair log likelihoods (26 x 26, row by row) and frequent words, both of bounded size."""

    pairs: list[float]
    words: list[str]


def sampled(docs: DataFrame, what: str) -> DataFrame:
    """About SAMPLE_DOCS texts, drawn by a hash, so reruns agree."""
    return hash_sample(docs.where(F.length("text") <= SAMPLE_CHARS).select("text"), SAMPLE_DOCS, what, "text")


def statistics(docs: DataFrame) -> Statistics:
    """Counts over all texts, each as often as it stands in ``docs``; the shuffle carries distinct words, and 676 pairs at most come back."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("word"))
    words, _ = save(words.groupBy("word").count())
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2))))
    counts = {r["pair"]: r["n"] for r in words.select(pair.alias("pair"), "count").groupBy("pair").agg(F.sum("count").alias("n")).collect()}
    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs = []
    for a in letters:
        row = [counts.get(a + b, 0) + 1 for b in letters]
        pairs += [math.log(n / sum(row)) for n in row]
    common = words.where((F.length("word") >= 4) & (F.col("count") >= 3)).orderBy(F.desc("count"), "word").limit(DICTIONARY)
    return Statistics(pairs, sorted(r["word"] for r in common.collect()))


def cut(rows: DataFrame, pattern: str) -> DataFrame:
    """One row per match: the columns of ``rows`` but text, and i, value, before, after, start, stop.

    ``rows`` has a key column that is unique; starts are running sums over a text's gaps and matches.
    """
    parts = rows.withColumn("_gaps", F.split("text", pattern, -1)).withColumn("_values", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    zipped = F.transform(
        F.col("_values"),
        lambda v, i: F.struct(
            i.alias("i"), v.alias("value"), F.right(F.get("_gaps", i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get("_gaps", i + 1), F.lit(CONTEXT)).alias("after"), F.length(F.get("_gaps", i)).cast("long").alias("gap"),
        ),
    )
    kept = [c for c in rows.columns if c != "text"]
    each = parts.select(*kept, F.explode(zipped).alias("m")).select(*kept, "m.*")
    run = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("value").cast("long")
    each = each.withColumn("stop", F.sum(F.col("gap") + size).over(run)).withColumn("start", F.col("stop") - size)
    return each.drop("gap")


def with_features(found: DataFrame, stats: Statistics) -> DataFrame:
    """The forest's inputs as columns f_<name>."""
    value, n = F.col("value"), F.length("value").cast("double")
    low, before, around = F.lower(value), F.lower("before"), F.lower(F.concat("before", F.lit(" "), "after"))
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    classes = F.translate(value, upper + upper.lower() + digits, "A" * 26 + "a" * 26 + "0" * 10)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    pairs = F.array(*[F.lit(x) for x in stats.pairs])
    spelled = F.regexp_replace(low, "[^a-z]", "")
    place = lambda i: (F.ascii(F.substr(spelled, i, F.lit(1))) - 97) * 26 + F.ascii(F.substr(spelled, i + 1, F.lit(1))) - 97
    steps = F.greatest(F.length(spelled) - 1, F.lit(0))
    likely = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), steps), F.lit(0.0), lambda a, i: a + F.get(pairs, place(i))) / steps).otherwise(F.lit(-6.0))
    covered = F.aggregate(
        F.filter(F.regexp_extract_all(low, F.lit("[a-z]{4,}"), F.lit(0)), lambda w: w.isin(stats.words or [""])), F.lit(0), lambda a, w: a + F.length(w)
    )
    made = {
        "length": n, "digit_share": count(value, "[0-9]") / n, "upper_share": count(value, "[A-Z]") / n,
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / n, "class_runs": count(classes, r"(.)\1*+") / n,
        "hex_only": value.rlike("^[0-9a-f]+$").cast("double"), "likelihood": likely, "coverage": covered / n,
        "slashes": count(value, "/"), "path_before": before.rlike(r"[/\\.][a-z0-9_.-]*$|https?:").cast("double"),
        "telling": count(before, TELLING),
        "benign": count(around, BENIGN), "quoted": before.rlike("[\"'`]$").cast("double"),
    }
    return found.withColumns({f"f_{k}": v.cast("double") for k, v in made.items()})


def labelled(found: DataFrame) -> DataFrame:
    """Findings whose label is known, with ``label`` 1 (secret) or 0."""
    value, before = F.col("value"), F.lower("before")
    assigned, wordy, reference = before.rlike(ASSIGNED), value.rlike(WORDY), value.rlike(REFERENCE)
    mixed = value.rlike("[0-9!@#$%^&*?~]") & value.rlike("[A-Za-z]")
    strange = wordy & (F.length(value) >= 8) & (F.col("f_likelihood") < UNLIKE)
    good = (value.rlike(PROVIDERS) & value.rlike("[0-9]")) | (assigned & ~reference & (mixed | strange))
    plain = wordy | value.rlike("^[0-9_/+-]+$") | value.rlike("^[a-z]+([_/-][a-z]+)+$")
    named = before.rlike(rf"({BENIGN})[\"']?\s*[=: ]\s*[\"']?$")
    # Letters or digits alone after a telling name are known where they are a frequent word; otherwise the forest decides.
    none = named | F.when(assigned, reference | (wordy & (F.col("f_coverage") == 1))).otherwise(plain)
    label = F.when(good & ~named, F.lit(1.0)).when(none, F.lit(0.0))
    return found.withColumn("label", label).where("label is not null")


def planted(texts: DataFrame) -> DataFrame:
    """Findings made up for ``texts`` (text): columns of :func:`cut` and ``label``; contents follow from the text, so reruns agree.

    The context is the text's own, and the label is known without looking at it.
    """
    kind = F.explode(F.sequence(F.lit(1), F.lit(PLANTS)))
    rows = texts.select("text", kind.alias("n")).withColumn("seed", F.sha2(F.concat("text", F.col("n").cast("string")), 512))
    digest = lambda a, n: F.substr("seed", F.lit(a), F.lit(n))
    dense = F.translate(F.base64(F.unhex("seed")), "+/=", "xY_")  # letters of both cases and digits
    some = lambda a, n: F.substr(dense, F.lit(a), F.lit(n))
    number = F.pmod(F.xxhash64("seed"), F.lit(997))
    words = F.filter(F.split(F.lower(F.left("text", F.lit(2000))), "[^a-z]+"), lambda w: F.length(w) >= 4)
    word = lambda k: F.coalesce(F.get(words, F.pmod(F.xxhash64("seed", F.lit(k)), F.greatest(F.size(words), F.lit(1))).cast("int")), F.lit("value"))
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    uuid = F.concat_ws("-", digest(1, 8), digest(9, 4), digest(13, 4), digest(17, 4), digest(21, 12))
    camel = cat(F.initcap(word(1)), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4)))
    path = cat("/", word(1), "/", word(2), "/", word(3), "_", word(4))
    # (label, before, value, after)
    kinds = [
        (1, 'token = "', digest(1, 40), '"'), (1, "password=", some(1, 11), ""), (1, "api_key: '", some(5, 32), "'"), (1, "SECRET_ACCESS_KEY=", some(3, 40), ""), (1, "", cat("AKIA", F.upper(F.translate(some(1, 16), "_", "Z"))), ""),
        (1, "Authorization: Bearer ", some(2, 44), ""), (1, "", cat("ghp_", F.translate(some(1, 36), "_", "a")), ""), (1, "private_key = ", digest(30, 48), ""), (1, "db_password: ", cat(word(1), "!", number.cast("string"), some(7, 3)), ""), (1, "", cat("sk_live_", F.translate(some(9, 24), "_", "b")), ""),
        (1, "client_secret: ", some(11, 28), ""), (1, "auth_token => '", digest(4, 32), "'"), (1, 'credential "', some(20, 20), '"'),
        (0, "commit ", digest(1, 40), ""), (0, "sha256: ", digest(1, 64), ""), (0, "md5 = ", digest(3, 32), ""), (0, "", uuid, ""), (0, "uuid=", uuid, ""), (0, "request id ", uuid, ""), (0, "", path, ".txt"), (0, "see https://example.org", path, ""),
        (0, "class ", camel, ""), (0, "", cat(F.initcap(word(1)), F.initcap(word(2)), "2", F.initcap(word(3))), ""), (0, "", F.concat_ws("_", word(1), word(2), word(3), number.cast("string")), " = 3"), (0, "build ", cat("release-2024-", number.cast("string"), "-x86_64"), ""),
        (0, "integrity sha512-", some(1, 60), ""), (0, "data:image/png;base64,", some(1, 60), ""), (0, "etag ", digest(8, 32), ""), (0, "file ", cat(word(1), "-", word(2), "-v2-", number.cast("string")), ".tar.gz"), (0, "order no ", F.conv(digest(1, 13), 16, 10), ""),
        (0, "password: ", word(1), " is needed"), (0, "token: ", cat("${", F.upper(word(2)), "}"), ""), (0, "the secret: ", cat(word(1), word(2)), ""), (0, "checksum ", digest(5, 40), ""), (0, "revision: ", digest(9, 40), ""), (0, "key ", F.concat_ws("-", word(1), word(2), word(3)), ""),
    ]
    made = F.array(*[F.struct(F.lit(float(y)).alias("label"), F.lit(a).alias("before"), v.alias("value"), F.lit(z).alias("after")) for y, a, v, z in kinds])
    chosen = F.get(made, F.pmod(F.xxhash64("seed", "n"), F.lit(len(kinds))).cast("int"))
    at = F.pmod(F.hash("seed"), F.greatest(F.lit(1), F.length("text") - CONTEXT)).cast("int") + 1
    rows = rows.withColumn("m", chosen)
    left, right = F.substr("text", at, F.lit(CONTEXT)), F.substr("text", at + CONTEXT, F.lit(CONTEXT))
    return rows.select(
        F.substr("seed", F.lit(1), F.lit(64)).alias("key"), F.col("n").alias("i"), F.col("m.value").alias("value"), "m.label",
        F.right(F.concat(left, F.lit(" "), F.col("m.before")), F.lit(CONTEXT)).alias("before"), F.left(F.concat("m.after", F.lit(" "), right), F.lit(CONTEXT)).alias("after"),
    )


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features")


def train(docs: DataFrame, promising: DataFrame, stats: Statistics, seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest of the labelled findings in two samples, one of any texts and one of texts with candidates; None if a class is missing."""
    rows = sampled(promising, "findings").unionByName(sampled(docs, "words")).distinct()
    rows, _ = save(rows.withColumn("key", F.sha2("text", 256)))
    known = labelled(with_features(cut(rows.where(F.col("text").rlike(BROAD)), BROAD), stats))
    made = with_features(planted(rows.select("text")), stats)
    inputs = ["label", "key", "i", "value", "before", *[f"f_{k}" for k in FEATURES]]
    known = known.select(*inputs).unionByName(made.select(*inputs))
    spread = Window.partitionBy("label").orderBy(F.xxhash64("value", "before"), "key", "i")
    known = known.withColumn("nth", F.row_number().over(spread)).where(F.col("nth") <= SAMPLE_FINDINGS // 2)
    known, _ = save(_assembler().transform(known.select("label", "key", "i", *[f"f_{k}" for k in FEATURES])).select("label", "features", "key", "i"))
    if known.select("label").distinct().count() < 2:
        return None
    ordered = known.coalesce(1).sortWithinPartitions("key", "i")  # SAMPLE_FINDINGS rows at most; one order makes reruns agree
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=2, seed=seed, subsamplingRate=0.7).fit(ordered)


def has_candidate(text: Column) -> Column:
    return F.coalesce(text.rlike(MARK) & text.rlike(CANDIDATE), F.lit(False))


def scan(docs: DataFrame, promising: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate of the distinct (doc_id, text): doc_id, th (hash of the text), i, value, start, stop, score, secret.

    ``promising``: the rows of ``docs`` that have candidates, with th.
    """
    docs = docs.where(F.col("text").isNotNull())
    stats = statistics(docs)
    model = train(docs, promising, stats)
    rows = promising.select("doc_id", "th", "text").distinct()
    rows = rows.withColumn("key", F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), "doc_id", "th"))
    found = cut(rows, CANDIDATE)
    if model is None:
        # Nothing to learn from: no candidate is removed by its looks; only telling assignments and formats are secrets.
        telling = F.lower("before").rlike(ASSIGNED) & ~F.col("value").rlike(WORDY) & ~F.col("value").rlike(REFERENCE)
        sure = (F.col("value").rlike(PROVIDERS) | telling).cast("double")
        scored = found.withColumn("score", sure)
    else:
        scored = model.transform(_assembler().transform(with_features(found, stats))).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("doc_id", "th", "i", "value", "start", "stop", "score", (F.col("score") >= threshold).alias("secret"))


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_candidates, n_secrets, spans, score.

    ``spans``: start:end of the secrets in code points, end exclusive, by start, comma-joined;
    ``score``: the highest of its candidates, 0 without any.  Null text has no candidates.  Rows that
    agree in id and text get one result each; a null id is kept.  Without labelled findings of both
    kinds (as in an empty table) only formats and assignments count.  Other columns are ignored.
    """
    docs = _prepared(docs, id_col, text_col)
    promising, _ = save(docs.where(has_candidate(F.col("text"))).withColumn("th", F.xxhash64("text")))
    found = scan(docs, promising, threshold)
    span = F.struct("start", "stop")
    per_doc = found.groupBy("doc_id", "th").agg(
        F.count("*").alias("n_candidates"), F.count_if("secret").alias("n_secrets"), F.max("score").alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("secret"), span))).alias("at"),
    )
    text = F.array_join(F.transform("at", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    per_doc = per_doc.withColumn("spans", text).withColumnsRenamed({"doc_id": "_doc", "th": "_th"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"))
    out = rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["_doc"]) & (rows["th"] == per_doc["_th"]), "left")
    return out.select(
        "doc_id", F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"), F.coalesce("n_secrets", F.lit(0)).cast("long").alias("n_secrets"),
        F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """``docs`` with each secret in the text replaced by ``mask``; other texts, rows and columns stay as they are.

    Only texts with candidates are shuffled.  The rest of the contract is that of :func:`secret_scan`.
    """
    text = F.col(text_col)
    # Rows with candidates are kept whole, in a struct, beside the working columns.
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    rows = docs.where(has_candidate(text)).select(own, F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    rows, _ = save(rows)
    found = scan(_prepared(docs, id_col, text_col), rows, threshold)
    flags = found.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("i", "secret"))).alias("flags")).where(F.exists("flags", lambda x: x["secret"]))
    flags = flags.withColumnsRenamed({"doc_id": "flag_doc", "th": "flag_th"})
    rows = rows.join(flags, rows["doc_id"].eqNullSafe(flags["flag_doc"]) & (rows["th"] == flags["flag_th"]), "left")
    rows = rows.withColumn("gaps", F.split("text", CANDIDATE, -1)).withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    shown = F.transform("found", lambda v, i: F.when(F.get("flags", i)["secret"], F.lit(mask)).otherwise(v))
    rebuilt = F.array_join(F.zip_with("gaps", shown, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    masked = F.when(F.col("flags").isNotNull(), rebuilt).otherwise(F.col("text"))
    rows = rows.select(*[masked.alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns])
    return rows.unionByName(docs.where(~has_candidate(text)))


def op7(spark, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``: doc_id, n_candidates, n_secrets, spans, score."""
    return secret_scan(table(spark, sf_dir, "documents"))
