"""Secret scans: candidates by pattern, false positives removed by a random forest.

Only DataFrame functions and Spark's own learners: no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import fresh, least_by_hash, saved

KEYS = r"(?:token|secret|passw(?:or)?d|passwd|passphrase|pwd|api[_\-]?key|access[_\-]?key|private[_\-]?key|auth(?:orization)?|bearer|credentials?)"
#: A candidate, the first that fits at a place: a private key's block; a URL; a well-known key's
#: format; the value that is
#: assigned to a name of a secret, of 8 or more characters of any kind; an unbroken run of the
#: characters that keys, hashes, numbers, addresses and paths are made of, of 12 or more, with a
#: digit, or of 20 or more in changing case. Closing punctuation isn't part of one. What is cheap
#: to see is looked at first.
CANDIDATE = (
    r"(?<![A-Za-z0-9])(?=\S)(?:-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s\\]*-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?<![+.\-])[A-Za-z][A-Za-z0-9+.\-]{1,20}://[^\s\"'<>]{3,}[^\s\"'<>.,;:!?)\]]"
    r"|(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,})(?![A-Za-z0-9])"
    rf"|(?<=[\s:=\"'])(?=[^\s\"'<>])(?:(?<=[rR]\s{{1,2}})(?<=(?i:bearer)\s{{1,2}})|(?<=[:=]\s{{0,2}}[\"']?)(?<=(?i:{KEYS})[\"']?\s{{0,2}}[:=]\s{{0,2}}[\"']?))(?!(?i:bearer)\s)[^\s\"'<>:=]?[^\s\"'<>]{{6,}}[^\s\"'<>.,;:)\]]"
    rf"|(?<![+/_.@\-])(?=[A-Za-z0-9+/_.@:\-]{{12}})(?=[A-Za-z+/_.@:\-]*[0-9]|(?=[A-Za-z+/]{{20}})[A-Z]*[a-z]+[A-Z]+[a-z]+[A-Z])(?![A-Za-z0-9_.\-]{{0,40}}(?i:{KEYS})[\"']?\s{{0,2}}[:=])[A-Za-z0-9+/_\-]+(?:[.@:][A-Za-z0-9+/_\-]+)*={{0,2}})"
)
#: Code points on either side of a candidate that its neighbouring words are taken from.
AROUND = 48
#: Formats that a provider publishes, and shapes that can't be secrets. A finding
#: of the corpus with one of them is labelled; all others are left to the forest.
PROVIDER = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9\-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_\-]{35}|eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+)$"
BENIGN = r"^(?:[0-9.:+/\-]+|[A-Za-z0-9_.+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+Z?)$"
KEYWORD = rf"(?i){KEYS}\W{{0,6}}$"
#: Words of ordinary identifiers, hosts, paths, notes and placeholders.
DICTIONARY = tuple(
    "about access account action active add address admin after agent alert all and any api app archive area array article asset audio auth author backup base batch before block blog body book build button cache call camera card cart case category center change chapter chart chat check city class client cloud code collection color column com comment commit common company config connect contact content context control copy core count country create current customer data database date day debug default delete demo deploy design dev device digest dir doc document domain download draft edit email error event example export false feature feed field file filter find first font foo form format frame from full game get group guide handler hash head header health help history home host html http https icon image import index info input install internal item job key label language last layout left length level library line link list load local log login mail main manager map market member memory menu message meta method mobile model module month music name net network new news node note null number object offer open option order org output owner page parent park part password path payment phone photo placeholder plan play plugin point policy post price private process prod product profile project public query read record release report request reset result return river role root router rule run sample save school script search secret section select send server service session set setting shop sign site size skill sort source stage start state static status step store story stream string style summary support sync system table tag task team template test text theme time title token tool total track train true type update upload url user value version video view web week widget word work world www year your zone xxxx changeme dummy fake redacted insert".split()
)
#: The most common pairs of letters in words.
PAIRS = tuple("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split())
#: The bounds of the labelled findings that the forest learns from: of the corpus, of each kind; planted.
SAMPLE, PLANTED = 10_000, 12_000


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, path, n, begin, value, left, right of each candidate in whole texts.

    ``begin`` counts code points; ``left`` and ``right`` are what stands around it; ``path`` is
    where the text is from. ``text_key`` tells rows of one doc_id apart.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("source", F.lit("")).alias("path"), "text", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("values"))
    rows = rows.filter(F.size("values") > 0).withColumn("between", F.split("text", CANDIDATE, -1)).drop("text")
    sizes = F.zip_with(F.slice("between", F.lit(1), F.size("values")), "values", lambda b, v: F.struct(F.length(b).alias("b"), F.length(v).alias("v")))
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x.b + x.v)))
    rows = rows.withColumn("sizes", ends)
    one = F.transform("values", lambda v, i: F.struct(i.alias("n"), (F.get("sizes", i) + F.length(F.get("between", i))).alias("begin"), v.alias("value"), F.right(F.get("between", i), F.lit(AROUND)).alias("left"), F.left(F.get("between", i + 1), F.lit(AROUND)).alias("right")))
    return rows.select("doc_id", "text_key", "path", F.explode(one).alias("c")).select("doc_id", "text_key", "path", "c.*")


def shape(value: Column) -> Column:
    """The classes of a value's characters: a, A, 0 or the character."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "0")


def features() -> dict[str, Column]:
    """Name to number: length, transitions, dictionary coverage, path and neighbouring words."""
    v, n = F.col("value"), F.length("value").cast("double")
    outline = shape(v)
    runs = F.length(F.regexp_replace(outline, r"(.)\1+", "$1")).cast("double")
    letters = F.lower(F.regexp_replace(v, "[^A-Za-z]", ""))
    chars = F.split(v, "(?!^)")
    pairs = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(x) - 1)), lambda i: F.substring(x, i, F.lit(2)))
    words = F.lower(F.regexp_replace(F.regexp_replace(v, "([a-z])([A-Z])", "$1 $2"), "[^A-Za-z]+", " "))
    known = F.length(F.regexp_replace(words, rf"\b(?:{'|'.join(DICTIONARY)})s?\b", "")).cast("double")

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(v, pattern, "")).cast("double") / n

    return {
        "length": F.least(n, F.lit(200.0)), "runs": (runs - 1) / n, "distinct": F.size(F.array_distinct(chars)) / n, "distinct_pairs": F.size(F.array_distinct(pairs(v))) / n,
        "common_pairs": F.size(F.filter(pairs(letters), lambda p: p.isin(*PAIRS))) / F.greatest(F.lit(1), F.length(letters) - 1),
        "digits": share("[^0-9]"), "upper": share("[^A-Z]"), "lower": share("[^a-z]"), "hex": share("[^0-9a-f]"), "signs": share("[A-Za-z0-9]"),
        "vowels": share("[^aeiouAEIOU]"), "dictionary": (F.length(words) - known) / n,
        "at": v.contains("@").cast("double"), "dots": F.length(F.regexp_replace(v, "[^.]", "")).cast("double"), "slashes": F.length(F.regexp_replace(v, "[^/:]", "")).cast("double"),
        "user_in_url": v.rlike(r"://[^/\s@]*:[^/\s@]+@").cast("double"), "last_part": F.length(F.regexp_extract(v, r"([A-Za-z0-9]*)$", 1)).cast("double"), "longest_part": F.array_max(F.transform(F.split(v, "[^A-Za-z0-9]+"), lambda p: F.length(p))).cast("double"),
        "path_test": F.col("path").rlike("(?i)test|example|sample|doc|readme").cast("double"), "path_config": F.col("path").rlike(r"(?i)\.(?:env|cfg|conf|ini|ya?ml|pem|key|properties)$").cast("double"),
        "keyword": F.col("left").rlike(KEYWORD).cast("double"), "hash_word": F.concat(F.col("left"), F.regexp_extract(v, "^[A-Za-z0-9-]{1,8}:", 0)).rlike(r"(?i)(?:sha-?[0-9]*|md5|checksum|digest|hash|commit|revision|etag|build|id|uuid)\W{0,4}$").cast("double"),
        "assigned": F.col("left").rlike(r"[=:]\s*[\"']?$").cast("double"), "quoted": (F.col("left").rlike("[\"']$") & F.col("right").rlike("^[\"']")).cast("double"),
        "left_word": F.length(F.regexp_extract("left", r"(\p{L}*)\W*$", 1)).cast("double"), "right_word": F.length(F.regexp_extract("right", r"^\W*(\p{L}*)", 1)).cast("double"),
    }


def known_label() -> Column:
    """Of the corpus: 1.0 a provider's format; 0.0 a shape that can't be a secret; null: unlabelled."""
    return F.when(F.col("value").rlike(PROVIDER), 1.0).when(F.col("value").rlike(BENIGN), 0.0)


def planted(spark: SparkSession, n: int = PLANTED, seed: int = 7) -> DataFrame:
    """path, value, left, right, known: labelled findings whose label is what they were made as.

    Secrets and look-alikes of equal number, made by Spark from hashes of their numbers and put
    among ordinary words, so that a label is no function of what the forest sees.
    """
    hashed = lambda *x: F.sha2(F.concat_ws(":", F.lit(seed), F.col("id"), *map(F.lit, x)), 256)
    draw = lambda x, k: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(x)), F.lit(k)).cast("int")
    pick = lambda x, xs: F.get(F.array(*map(F.lit, xs)), draw(x, len(xs)))
    word = lambda x: pick(x, DICTIONARY)
    mixed = lambda x, k: F.substring(F.translate(F.concat(F.base64(F.unhex(hashed(x))), F.base64(F.unhex(hashed(x, "more")))), "+/=", "aB3"), 1, k)
    upper = lambda x, k: F.substring(F.upper(mixed(x, k)), 1, k)
    digits = lambda x, k: F.substring(F.regexp_replace(F.concat(hashed(x), hashed(x, "more")), "[a-f]", ""), 1, k)
    letters = lambda x, k: F.substring(F.regexp_replace(F.concat(mixed(x, 80), F.base64(F.unhex(hashed(x, "l")))), "[^A-Za-z]", ""), 1, k)
    size = lambda x, low, high: draw(x, high - low) + low
    some = lambda x, low, high: F.substring(mixed(x, 80), F.lit(1), size(f"{x} size", low, high))
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    secret_names = ["token = \"", "api_key: ", "password = '", "secret=", "Authorization: Bearer ", "passwd: ", "access_key = ", "client_secret: \"", "pwd=", "password: ", "API_KEY=", "auth token: ", "password:", "token:"]
    any_lead = text(word("a"), " ", pick("lead", ["the ", "with ", "is ", "at ", "(", "see ", "from ", "", "= ", ": ", "key ", "\""]))
    secret_lead = text(word("a"), " ", pick("name", secret_names))
    hash_lead = text(word("a"), " ", pick("hash", ["commit ", "sha256:", "md5: ", "checksum ", "digest=", "revision ", "etag: \"", "build ", "hash ", "id=", "request id "]))
    secrets = [
        (F.substring(hashed("v"), F.lit(1), pick("hex", [32, 40, 64])), secret_lead), (some("v", 20, 64), secret_lead), (letters("v", 20), secret_lead),
        (text(F.initcap(word("b")), digits("v", 4), pick("sign", list("!@#$%&*_-")), word("c")), secret_lead), (some("v", 9, 16), secret_lead), (text(word("b"), F.substring(digits("v", 4), F.lit(1), size("n", 2, 5))), secret_lead), (text(F.translate(F.initcap(word("b")), "oeai", "03@1"), pick("sign", list("!&#_-")), digits("v", 3)), secret_lead),
        (text(pick("p", ["AKIA", "ASIA"]), upper("v", 16)), any_lead), (text(pick("p", ["ghp_", "gho_", "ghs_"]), mixed("v", 36)), any_lead), (text("sk_live_", mixed("v", 24)), any_lead),
        (text("xoxb-", digits("v", 12), "-", mixed("w", 24)), any_lead), (text("AIza", mixed("v", 35)), any_lead), (text("eyJ", mixed("v", 33), ".eyJ", mixed("w", 60), ".", mixed("x", 43)), any_lead),
        (text(pick("p", ["postgres", "mysql", "mongodb", "redis", "amqp", "https"]), "://", word("b"), ":", some("v", 8, 20), "@", word("c"), ".", word("d"), pick("t", [".com", ".internal:5432", ":6379"]), "/", word("e")), any_lead),
        (text("https://hooks.", word("b"), ".com/services/T", upper("v", 8), "/B", upper("w", 8), "/", mixed("x", 24)), any_lead),
        (text("-----BEGIN ", pick("p", ["RSA ", "EC ", ""]), "PRIVATE KEY-----\n", mixed("v", 64), "\n", mixed("w", 64), "\n-----END PRIVATE KEY-----"), any_lead),
    ]
    alike = [
        (F.substring(hashed("v"), F.lit(1), pick("hex", [32, 40, 64])), hash_lead), (text(word("b"), "-", F.substring(hashed("v"), 1, 12)), any_lead), (digits("v", 16), any_lead), (text(digits("v", 4), " ", digits("w", 8)), any_lead),
        (text(F.substring(hashed("v"), 1, 8), "-", F.substring(hashed("v"), 9, 4), "-", F.substring(hashed("v"), 13, 4), "-", F.substring(hashed("v"), 17, 4), "-", F.substring(hashed("v"), 21, 12)), pick("u", ["id ", "request ", "uuid: ", "session=", "key "])),
        (text(word("b"), ".", word("c"), digits("v", 2), "@", word("d"), ".com"), any_lead), (text("10.", digits("v", 2), ".", digits("w", 2), ".", digits("x", 2), ":8", digits("y", 3)), any_lead),
        (text("https://www.", word("b"), ".com/", word("c"), "/", word("d"), "-", word("e"), "?", word("f"), "=", digits("v", 5)), any_lead), (text("https://", word("b"), ".org/", word("c"), "/", digits("v", 6), ".html"), any_lead),
        (text(word("b"), "/", word("c"), "/", word("d"), "-", digits("v", 1), ".", digits("w", 2), ".tar.gz"), any_lead), (text("20", digits("v", 2), "-0", digits("w", 1), "-1", digits("x", 1), "T1", digits("y", 1), ":2", digits("z", 1), ":3", digits("q", 1)), any_lead),
        (text(pick("p", ["your_", "my-", "example_", "insert_", "test_", "dummy-"]), pick("q", ["api_key", "password", "token", "secret_here", "key_1234", "value"]), pick("r", ["", "_here", "123", "_1"])), secret_lead),
        (text(pick("p", ["${", "{{", "$(", "os.environ.", "process.env."]), F.upper(word("b")), "_", F.upper(word("c")), pick("r", ["}", "}}", ")", ""])), secret_lead), (pick("p", ["changeme123", "xxxxxxxxxxxx", "************", "placeholder", "undefined", "redacted", "password123", "required."]), secret_lead),
        (text(word("b"), "_", word("c"), "_", word("d"), "_", digits("v", 2)), any_lead), (text(word("b"), F.initcap(word("c")), F.initcap(word("d")), digits("v", 1), F.initcap(word("e"))), any_lead), (text(word("b"), F.initcap(word("c")), F.initcap(word("d")), F.initcap(word("e"))), any_lead),
        (text(word("b"), " ", word("c")), secret_lead),
    ]

    def rows(kinds: list, label: float) -> DataFrame:
        one = draw("kind", len(kinds))
        chosen = reduce(lambda w, i: w.when(one == i, F.struct(kinds[i][0].alias("value"), F.lit(None).cast("string").alias("_") if kinds[i][1] is None else kinds[i][1].alias("_"))), range(1, len(kinds)), F.when(one == 0, F.struct(kinds[0][0].alias("value"), kinds[0][1].alias("_"))))
        path = pick("path", ["", "", "web", "books", "config/app.env", "src/main.py", "docs/readme.md", "deploy.yaml", "tests/test_api.py"])
        right = F.when(F.col("left").rlike("\"$"), "\" and").when(F.col("left").rlike("'$"), "' and").otherwise(pick("right", ["", " and then", "\n", ", which", ". It", " ", "; "]))
        made = spark.range(n // 2).withColumn("id", F.col("id") * 2 + int(label)).select("id", path.alias("path"), chosen.alias("c"))
        return made.select("id", "path", "c.value", F.col("c._").alias("left")).withColumn("right", right).withColumn("known", F.lit(label)).drop("id")

    return rows(secrets, 1.0).unionByName(rows(alike, 0.0))


def scan(docs: DataFrame, sample: int = SAMPLE, plants: int = PLANTED, trees: int = 40, depth: int = 10, seed: int = 7) -> DataFrame:
    """doc_id, text_key, n, begin, n_chars, value_sha256, known, probability, is_secret of each finding.

    The forest learns from labelled findings: ``plants`` that are planted, and at most ``sample`` of each
    kind that the corpus itself labels (``known``), those of least hash. It judges every finding,
    known or not; ``is_secret`` is its verdict at 0.5.

    Null and empty texts have no findings, a null source an empty path; long texts are searched
    whole. Repeated rows give repeated findings, an empty table an empty result; other columns are
    ignored. The value itself isn't given, only its digest. Nothing is shuffled but the labels.
    """
    spark = docs.sparkSession
    found = saved(candidates(docs), "secrets-candidates")
    named = {f"f_{k}": c for k, c in features().items()}
    inputs = list(named)
    rows = found.withColumn("known", known_label()).withColumns(named)
    labelled = least_by_hash(rows.filter("known is not null"), "known", sample, ["value", "left", "doc_id", "n"], inputs).select("known", *inputs)
    labelled = saved(labelled.union(planted(spark, plants, seed).withColumns(named).select("known", *inputs)), "secrets-labelled")
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    forest = RandomForestClassifier(labelCol="known", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, rawPredictionCol="raw", probabilityCol="p", predictionCol="verdict", featureSubsetStrategy="sqrt")
    model = forest.fit(assembler.transform(labelled.repartition(1).sortWithinPartitions("known", *inputs)))  # bounded
    judged = model.transform(assembler.transform(rows))
    p = vector_to_array(F.col("p"))[1]
    return judged.select("doc_id", "text_key", "n", "begin", F.length("value").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "known", p.alias("probability"), (p > 0.5).alias("is_secret"))


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark``; a column n_chars follows the text.

    All rows and columns stay, repeated ones too. Rows without a secret, or text, are left as they are.
    """
    flags, key, doc, text_key = fresh(docs, "flags", "key", "doc", "text_key")
    flagged = scan(docs, **options).filter("is_secret").groupBy("doc_id", "text_key").agg(F.collect_set("n").alias(flags))  # one document's
    flagged = saved(flagged.select(F.col("doc_id").alias(doc), F.col("text_key").alias(text_key), flags), "secrets-flagged")
    rows = docs.withColumn(key, F.xxhash64("text"))
    rows = rows.join(flagged.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(flagged[doc]) & (rows[key] == flagged[text_key]), "left")
    between, values = F.split("text", CANDIDATE, -1), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    shown = F.transform(values, lambda v, i: F.when(F.array_contains(flags, i), F.lit(mark)).otherwise(v))
    text = F.when(F.col(flags).isNull(), F.col("text")).otherwise(F.array_join(F.zip_with(between, shown, lambda b, v: F.concat(b, F.coalesce(v, F.lit("")))), ""))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(flags).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)
