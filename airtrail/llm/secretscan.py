"""Secrets in documents: random strings and assigned values found by pattern, false positives removed by a random forest. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import smallest_by_hash

# a private key block; whatever is assigned to a password, secret, token or key; a run of at least 16 signs of keys and encodings with a digit in it
BLOCK = r"-----BEGIN [A-Z ]*?PRIVATE KEY-----[^-]*+-----END [A-Z ]*?PRIVATE KEY-----"
ASSIGNED = r"(?<=[:=\"' ])(?<=[:=] ?[\"']?)(?<=(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']? ?[:=] ?[\"']?)[^\s\"'`,;<>(){}\[\]]++"
RANDOM = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+"
FOUND = f"{BLOCK}|{ASSIGNED}|{RANDOM}"
MASK = "[SECRET]"
LEFT, RIGHT = 48, 24  # characters of the neighbourhood
WORDS = (
    "access", "account", "admin", "api", "auth", "backup", "book", "build", "change", "client", "code", "color", "company", "config", "content", "count",
    "data", "date", "default", "demo", "dummy", "error", "example", "file", "final", "first", "font", "form", "group", "here", "home", "host", "image",
    "index", "insert", "item", "key", "last", "line", "link", "list", "local", "login", "main", "name", "news", "number", "order", "page", "pass", "photo",
    "place", "post", "private", "product", "public", "release", "report", "sample", "secret", "server", "session", "size", "style", "system", "table",
    "test", "text", "time", "title", "token", "type", "update", "user", "value", "version", "video", "view", "week", "word", "year", "your",
)
SECRET_WORDS = r"token|secret|passw|passwd|pwd|api.?key|access.?key|private.?key|auth|bearer|credential"
OTHER_WORDS = r"commit|sha-?[0-9]|md5|hash|digest|etag|integrity|checksum|uuid|guid|order|invoice|card|phone|isbn|serial|revision|version|build"
FEATURES = (
    "size", "digits", "capitals", "signs", "distinct", "turns", "vowels", "hexadecimal", "covered", "slashes", "at_path", "address",
    "secret_word", "other_word", "assigned", "quoted", "block",
)


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, ``number, start, length, value, before, after`` of every random-looking string in ``text``.

    ``start`` counts characters from 0; ``before`` and ``after`` reach at most to the next candidate. ``keep`` must name a text.
    """
    values, gaps = F.regexp_extract_all("text", F.lit(FOUND), F.lit(0)), F.split("text", FOUND, -1)
    both = docs.select(*keep, values.alias("_values"), gaps.alias("_gaps")).filter("size(_values) > 0")
    near = F.transform("_values", lambda v, i: F.struct(
        v.alias("value"), F.length(F.get("_gaps", i)).alias("gap"), F.right(F.get("_gaps", i), F.lit(LEFT)).alias("before"), F.left(F.get("_gaps", i + 1), F.lit(RIGHT)).alias("after")))
    each = both.select(*keep, F.posexplode(near).alias("number", "_c")).select(*keep, "number", "_c.*").dropDuplicates([*keep, "number"])
    upto = Window.partitionBy(*keep).orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("value").cast("long")
    return each.withColumn("length", length).withColumn("start", F.sum(F.col("gap") + F.col("length")).over(upto) - F.col("length")).drop("gap")


def features(found: DataFrame) -> DataFrame:
    """Adds the columns of ``FEATURES``: length, kinds of signs and turns from one kind to another, share covered by dictionary
    words, path and address signs around, neighbouring words."""
    size = F.length("value").cast("double")
    low, before = F.lower("value"), F.lower("before")

    def share(pattern: str) -> Column:
        return F.regexp_count("value", F.lit(pattern)) / size

    def yes(column: Column) -> Column:
        return column.cast("double")

    turns = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    columns = {
        "size": F.log2(size), "digits": share("[0-9]"), "capitals": share("[A-Z]"), "signs": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / size, "turns": share(turns), "vowels": share("[aeiouAEIOU]"),
        "hexadecimal": yes(F.col("value").rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "covered": 1 - F.length(F.regexp_replace(low, "|".join(sorted(WORDS, key=lambda w: (-len(w), w))), "")) / size,
        "slashes": share("/"), "at_path": yes(F.col("before").rlike(r"[./@\\]$") | F.col("after").rlike(r"^[.@\\][A-Za-z]")),
        "address": yes(before.rlike(r"(://|www\.)\S*$")), "secret_word": yes(before.rlike(SECRET_WORDS)), "other_word": yes(before.rlike(OTHER_WORDS)),
        "assigned": yes(before.rlike(r"([=:]|=>|bearer)\s*[\"']?$")), "quoted": yes(F.col("before").rlike("[\"']$") & F.col("after").rlike("^=?[\"']")),
        "block": yes(F.col("value").startswith("-----BEGIN")),
    }
    return found.withColumns({name: F.coalesce(columns[name], F.lit(0.0)) for name in FEATURES})


def findings(docs: DataFrame, limit: int = 300) -> DataFrame:
    """Labelled findings ``text, label``, made from at most ``limit`` documents: their own words around values that hashes of
    theirs give, in contexts that were judged once. A set of reviewed findings of the same form can stand in its place."""
    picked = smallest_by_hash(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").withColumn("_all", F.lit(0)), ["_all"], limit, "doc_id")
    seed = F.concat_ws(":", F.col("doc_id").cast("string"), "kind", "form")
    long = F.sha2(seed, 256)
    base = F.base64(F.unhex(F.substring(long, 1, 60)))
    web = F.translate(base, "+/", "-_")
    digits = F.translate(F.substring(long, 1, 16), "abcdef", "123456")
    uuid = F.concat_ws("-", *[F.substring(long, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    name = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.crc32(seed.cast("binary")) % len(WORDS) + 1).cast("int"))
    # a word of the document itself: the first of six letters or more, else a shorter or a listed one
    own = F.coalesce(*[F.nullif(F.regexp_extract("text", rf"\b([a-z]{{{n},{n + 6}}})\b", 1), F.lit("")) for n in (6, 4, 3)], name)
    value = {
        "sha1": F.sha1(seed), "SHA1": F.upper(F.sha1(seed)), "sha256": long, "md5": F.md5(seed), "base64": base, "web64": web,
        "account": F.concat(F.lit("AK"), F.upper(F.translate(F.substring(F.md5(seed), 1, 18), "0189", "QRST")), F.lit("7")), "digits": digits, "uuid": uuid,
        "words": F.concat_ws("_", F.lit("your"), name, F.lit("example"), F.substring(digits, 1, 4)),
        "short": F.concat(F.initcap(F.substring(F.md5(seed), 2, 3)), F.substring(base, 1, 5), F.substring(digits, 1, 2)),
        "signed": F.concat(F.initcap(name), F.lit("$"), F.substring(F.md5(seed), 1, 4), F.lit("!"), F.substring(digits, 1, 1)),
        "letters": F.translate(F.substring(long, 1, 24), "0123456789", "ghjkmpqrst"), "few_letters": F.translate(F.substring(long, 30, 6), "0123456789", "aelstnriou"), "word": name, "plain": own, "joined": F.concat(own, F.lit("_"), name), "two_words": F.concat(name, F.lit("-"), F.lower(name)),
        "pem": F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), base, base, F.lit("\n"), base, F.lit("\n-----END RSA PRIVATE KEY-----")),
        "path": F.concat_ws("/", F.lit("images"), name, F.lit("2019/05"), digits),
    }
    random = ("sha1", "SHA1", "sha256", "md5", "base64", "web64", "account")
    yes = ('token = "{}"', 'TOKEN = "{}"!!', "api_key: '{}'", "password={}", 'secret="{}",', "Authorization: Bearer {}", '"access_token":"{}"', "AWS_SECRET_ACCESS_KEY={}", "passwd: {}")
    no = {
        "commit {}": ("sha1",), "sha256:{}": ("sha256",), "md5 sum {}": ("md5",), 'etag "{}"': ("md5", "sha1"), 'integrity="sha384-{}"': ("base64",),
        "/static/{}.png": ("sha1", "md5"), "https://example.org/a/{}": ("uuid", "sha1", "web64"), "id={}": ("uuid",), 'uuid: "{}"': ("uuid",), "order {}": ("digits", "uuid"),
        "card {} or": ("digits",), "{}": ("digits", "path", "words", "uuid"), 'token = "{}"': ("words",), "password={}": ("words",), "api_key: '{}'": ("words",),
        'src="/{}.jpg"': ("path",), "version {}": ("digits", "sha1"), "hash {}": ("sha1", "md5", "sha256"),
    }
    told = ("password={}", "passwd: {}", 'secret="{}",', "api_key: '{}'", 'token = "{}"')
    kinds = [(form, kind, 1.0) for form in yes for kind in random] + [(form, kind, 1.0) for form in told for kind in ("short", "signed", "letters")] + [("{}", "pem", 1.0), ("key {}", "pem", 1.0)]
    kinds += [(form, kind, 0.0) for form in told for kind in ("word", "two_words", "plain", "joined", "few_letters")]
    kinds += [(form, kind, 0.0) for form, of in no.items() for kind in of]
    forms = docs.sparkSession.createDataFrame(kinds, "form string, kind string, label double")
    given = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in value.items()])
    spread = picked.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("_turn"))
    forms = forms.withColumn("_turn", F.pmod(F.xxhash64("form", "kind"), F.lit(8)) + 1)
    # each document takes the forms of its turns: ids choose about an eighth of all forms for each
    mine = spread.filter(F.pmod(F.xxhash64("doc_id"), F.lit(8)) + 1 == F.col("_turn")).join(F.broadcast(forms), "_turn")
    words = F.slice(F.split(F.translate("text", "\n", " "), " "), 1, 5)
    shift = (F.crc32(seed.cast("binary")) % 5 + 1).cast("int")
    around = F.array_join(F.slice(words, 1, shift), " ")
    return mine.select(F.concat(around, F.lit(" "), F.replace(F.col("form"), F.lit("{}"), given), F.lit(" "), F.coalesce(F.get(words, F.lit(0)), F.lit(""))).alias("text"), "label")


def fit(labelled: DataFrame, trees: int = 24, depth: int = 7, seed: int = 5, most: int = 50_000):
    """A forest over the features of at most ``most`` labelled findings ``text, label`` (label 1: a secret).

    A text with several candidates speaks for its longest one. Without findings of both labels there is no forest: None.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = features(candidates(labelled.limit(most), "text", "label")).withColumn(
        "_n", F.row_number().over(Window.partitionBy("text").orderBy(F.desc("length"), "start"))).filter("_n = 1")
    rows = settle(rows.select("label", *FEATURES), "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(rows)


def scan(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """``doc_id, text_key, number, start, length, value, score, secret`` of every candidate in the whole texts.

    ``score`` is the share of the trees' votes for a secret; without a forest it is null and nothing counts as a secret. Null and empty texts have no candidates; a null doc_id stays. Rows
    with the same doc_id and text give their candidates once. Other columns are not read.
    """
    from pyspark.ml.functions import vector_to_array

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    rated = features(candidates(keyed, "doc_id", "text_key"))
    score = F.lit(None).cast("double")
    if model is not None:
        rated, score = model.transform(rated), F.round(vector_to_array("probability")[1], 9)
    return rated.select(
        "doc_id", "text_key", "number", "start", "length", "value", score.alias("score"), F.coalesce(score >= threshold, F.lit(False)).alias("secret"))


def secrets(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """``id, key, numbers``: the candidates of each text that are secrets."""
    return scan(docs, model, threshold).filter("secret").groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.collect_list("number").alias("numbers"))


def redact(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with each secret in ``text`` put out by ``MASK``; ``n_chars``, if there, follows the new text."""
    return put_out(docs, settle(secrets(docs, model, threshold), "secrets"))


def put_out(docs: DataFrame, secrets: DataFrame) -> DataFrame:
    """``redact`` with written ``secrets``: few findings are sent to the texts by Catalyst's own choice, as their size is known."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "doc_id", "text", F.xxhash64("text").alias("text_key"))
    joined = whole.join(secrets, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    values, gaps = F.regexp_extract_all("text", F.lit(FOUND), F.lit(0)), F.split("text", FOUND, -1)
    parts = F.transform(gaps, lambda g, i: F.concat(g, F.when(F.array_contains("numbers", i), F.lit(MASK)).otherwise(F.coalesce(F.get(values, i), F.lit("")))))
    hit = F.col("numbers").isNotNull()
    out = joined.select("whole", hit.alias("hit"), F.when(hit, F.array_join(parts, "")).otherwise(F.col("text")).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("hit"), F.length("text").cast("long")).otherwise(F.col("whole").getField("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[new.get(c, F.col("whole").getField(c)).alias(c) for c in docs.columns])
