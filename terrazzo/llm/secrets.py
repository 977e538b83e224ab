"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of twelve or more letters, digits and _ - + / . ~ with a digit in it (up to two = may end it).
Its features are its length, shares of character classes, transitions between classes, variety of characters,
how much of it dictionary words cover, signs of paths and addresses, and the words and signs around it. The
forest learns from labelled findings (`labelled_findings` makes a set of common secrets and of what is often
mistaken for them; any table of (value, before, after, label) does). Everything is made of DataFrame functions
and Spark's own forest; the values themselves leave a report only as digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.llm.common import pick

CHARS = r"A-Za-z0-9_\-+/.~"
#: What known kinds of keys begin with, and so many characters that follow; they need no digit.
FORMS = rf"(?:(?:AKIA|ASIA)[A-Z2-7]{{16}}(?![{CHARS}])|(?:gh[pousr]_[A-Za-z0-9]{{30}}|xox[abprs]-|sk_(?:live|test)_|AIza|eyJ[A-Za-z0-9_-]+\.|glpat-)[{CHARS}]{{8,}}={{0,2}}|-----BEGIN (?:[A-Z]+ ){{0,2}}PRIVATE KEY-----)"
CANDIDATE = rf"(?<![{CHARS}])(?:(?=[A-Za-z_\-+/.~]*[0-9])[{CHARS}]{{12,}}={{0,2}}|{FORMS})"
#: Values of any length and signs that a secret word names; its look-behind needs a regex of Java's kind.
ASSIGNED = r"(?<=(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|auth(?:orization)?)[\"']?\s{0,3}[=:]\s{0,3}[\"'`]?|(?i:bearer)\s)[^\s\"'`,;<>=:]+"
FOUND = rf"{CANDIDATE}|(?<![{CHARS}]){ASSIGNED}"
AROUND = 40
DICTIONARY = """access account admin about after again also and any app application are auth backup bin bool build cache
client code com commit common config content core count data date default dev dist doc docs document download
error event example file files final for from group have home host html http https image img include index info
input int into iso java key lang latest latin lib library license list local log long mail main media model name
net new news node not null number object old only open org out package page pages path php post private project
proto public python query release report request res resource root run script search secret server service session
set site size src start stat static string style system table temp test text that the this time token tmp type update
url usr user utf util value var version view web widget window with work www xml year
die der das und nicht ein eine mit für auf von les des une est dans que pour los las una del por con""".split()
SECRET_WORDS = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|auth(orization)?|bearer|login)\W{0,6}$"
PLAIN_WORDS = r"(?i)(commit|sha-?1|sha256|md5|checksum|digest|uuid|guid|revision|etag|build|version|isbn|phone|tel|order|invoice|id|no|nr|number)\W{0,4}$"
KNOWN = r"^(AKIA|ASIA)[A-Z2-7]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}|^xox[abprs]-|^sk_(live|test)_|^AIza|^eyJ[A-Za-z0-9_-]+\.|^glpat-|^-----BEGIN [A-Z ]*PRIVATE KEY-----$"
FEATURES = "n digits uppers lowers others changes variety hex dictionary slashes dots dashes known secret_word plain_word assigned quoted address uuid number".split()
LABEL = "label"


def with_features(df: DataFrame) -> DataFrame:
    """`df`, which has value, before and after, with the FEATURES columns as doubles."""
    v, n = F.col("value"), F.length("value")
    digits, upper, lower = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    kinds = F.translate(v, digits + upper + lower + "_-+/.~=", "0" * 10 + "A" * 26 + "a" * 26 + "-" * 7)

    def share(chars: str) -> Column:
        return F.lit(1.0) - F.length(F.translate(v, chars, "")) / n

    def count(sign: str) -> Column:
        return (n - F.length(F.translate(v, sign, ""))).cast("double")

    runs = F.regexp_extract_all(F.lower(v), F.lit("[a-z]{3,}"), F.lit(0))
    known = F.filter(runs, lambda w: F.array_contains(F.array(*map(F.lit, DICTIONARY)), w))
    covered = F.aggregate(known, F.lit(0), lambda s, w: s + F.length(w))
    flag = lambda c: c.cast("double")
    return df.withColumns(
        {
            "n": n.cast("double"),
            "digits": share(digits),
            "uppers": share(upper),
            "lowers": share(lower),
            "others": share("_-+/.~="),
            "changes": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
            "variety": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(40)),
            "hex": flag(v.rlike("^[0-9a-f]+$") | v.rlike("^[0-9A-F]+$")),
            "dictionary": covered / n,
            "slashes": count("/"),
            "dots": count("."),
            "dashes": count("-"),
            "known": flag(v.rlike(KNOWN)),
            "secret_word": flag(F.col("before").rlike(SECRET_WORDS)),
            "plain_word": flag(F.col("before").rlike(PLAIN_WORDS)),
            "assigned": flag(F.col("before").rlike("[=:]\\s*[\"']?$")),
            "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
            "address": flag(F.col("before").rlike("(://|@|www\\.)\\S*$") | F.col("after").startswith("@") | v.rlike("(?i)\\.(com|org|net|io|html?|php|js|py|txt|pdf|png|jpe?g)\\b")),
            "uuid": flag(v.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
            "number": flag(v.rlike(r"^[0-9.+/_\-]+$")),
        }
    )


def labelled_findings(spark: SparkSession, each: int = 120) -> DataFrame:
    """Rows (value, before, after, label): `each` of every kind of secret (1) and of look-alikes (0), always the same."""
    h = "sha2(concat('terrazzo', k, '/', id), 256)"
    b64 = f"base64(unhex(concat({h}, sha2({h}, 256))))"
    alnum = f"translate({b64}, '+/=', 'Qx7')"
    pick_word = lambda ws, salt: f"element_at(array({', '.join(repr(w) for w in ws)}), cast(pmod(xxhash64(id, '{salt}'), {len(ws)}) + 1 as int))"
    prose = pick_word(["and then the ", "was seen in ", "of that ", "please use ", "wurde ", "dans la ", "de los ", "see ", ""], "p")
    sure = pick_word(["password=", "password: ", "passwd = \"", "token = \"", "token: ", "api_key=", "apikey='", "secret = '", "client_secret: ", "auth_token=", "access_key = \"", "Bearer "], "s")
    close = "case when right(before, 1) in ('\"', '''') then right(before, 1) else ' ' end"
    base32 = f"substr(translate(upper({alnum}), '0189', 'ABCD'), 1, 16)"
    kinds = [
        (1, f"concat('AKIA', {base32})", f"concat({prose}, {pick_word(['', 'aws key ', 'AWS_ACCESS_KEY_ID=', 'key: '], 'a')})"),
        (1, f"substr({h}, 1, 18)", sure),
        (1, f"substr({h}, 1, 40)", sure),
        (1, f"substr({h}, 1, 12 + cast(pmod(id, 40) as int))", sure),
        (1, f"substr({alnum}, 1, 16 + cast(pmod(id, 30) as int))", sure),
        (1, f"concat('ghp_', substr({alnum}, 1, 36))", prose),
        (1, f"concat('sk_live_', substr({alnum}, 1, 24))", prose),
        (1, f"concat('xoxb-', substr(translate({h}, 'abcdef', '123456'), 1, 11), '-', substr({alnum}, 1, 24))", prose),
        (1, f"substr({b64}, 1, 40)", sure),
        (1, f"concat('-----BEGIN ', {pick_word(['', 'RSA ', 'EC ', 'OPENSSH ', 'ENCRYPTED '], 'b')}, 'PRIVATE KEY-----')", prose),
        (0, f"substr(translate({h}, 'abcdef', '730219'), 1, 12 + cast(pmod(id, 8) as int))", f"concat({prose}, {pick_word(['', '', 'number ', 'tel '], 'n')})"),
        (0, f"substr({h}, 1, 40)", f"concat({prose}, {pick_word(['commit ', 'sha1: ', 'revision ', 'checksum ', ''], 'c')})"),
        (0, f"substr({h}, 1, 32)", f"concat({prose}, {pick_word(['md5 ', 'md5: ', 'etag ', 'digest ', ''], 'm')})"),
        (0, f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21, 12))", f"concat({prose}, {pick_word(['uuid ', 'id ', '', 'session id: '], 'u')})"),
        (0, f"concat('mail', pmod(id, 97), '.', {pick_word(['example.com', 'host.net', 'site.org'], 'd')})", "concat('user', pmod(id, 31), '@')"),
        (0, f"concat('/usr/lib/python3.', pmod(id, 14), '/', {pick_word(['site-packages', 'config/index', 'test_util'], 'f')}, '.py')", prose),
        (0, f"concat('www.example.com/page', pmod(id, 500), '/', substr({h}, 1, 6))", "'https://'"),
        (0, f"concat({pick_word(['report', 'window', 'release', 'data_table'], 'r')}, '_', 2000 + pmod(id, 25), '_', {pick_word(['final', 'v2', 'update', 'backup'], 'v')}, '_', pmod(id, 31))", prose),
        (0, "concat(2000 + pmod(id, 25), '-', lpad(pmod(id, 12) + 1, 2, '0'), '-', lpad(pmod(id, 28) + 1, 2, '0'), 'T10.', lpad(pmod(id, 60), 2, '0'))", prose),
        (0, "concat_ws('.', 10 + pmod(id, 200), 100 + pmod(id * 7, 150), 100 + pmod(id * 3, 150), 10 + pmod(id, 90))", prose),
        (0, f"concat('word', {pick_word(['ingerth', 'heration', 'keitung', 'mentelle'], 'w')}, pmod(id, 1000))", prose),
    ]
    of = lambda i: "case k " + " ".join(f"when {k} then {kind[i]}" for k, kind in enumerate(kinds)) + " end"
    ids = spark.range(0, each * len(kinds), 1, 1).selectExpr(f"id % {each} as id", f"id div {each} as k")
    rows = ids.selectExpr(f"{of(1)} as value", f"{of(2)} as before", f"cast({of(0)} as double) as {LABEL}")
    return rows.selectExpr("value", "before", f"{close} as after", LABEL).where(F.length("value") >= 12)


def train(findings: DataFrame, trees: int = 24, depth: int = 8):
    """A random forest model on the features of labelled findings."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = with_features(findings).select(*FEATURES, LABEL).repartition(1).sortWithinPartitions(*FEATURES, LABEL)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=17, featureSubsetStrategy="onethird").fit(rows)


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (row, doc_id, value, start, before, after): every place of every candidate, from 0; `row` tells rows of docs apart.

    The pieces between matches give the places, so a value inside a longer run is none. Null texts have none;
    whole texts are searched.
    """
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    d = d.withColumn("found", F.regexp_extract_all("text", F.lit(FOUND), F.lit(0))).where(F.size("found") > 0)
    d = d.withColumn("row", F.monotonically_increasing_id()).withColumn("pieces", F.split("text", FOUND, -1))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + F.length(x["pieces"])
        return F.struct((at + F.length(x["found"])).alias("at"), F.array_append(s["starts"], at).alias("starts"))

    d = d.withColumn("pieces", F.slice("pieces", 1, F.size("found")))
    zipped = F.arrays_zip("pieces", "found")
    starts = F.aggregate(zipped, none, step)["starts"]
    each = d.withColumn("starts", starts).select("row", "doc_id", "text", F.explode(F.arrays_zip("found", "starts")).alias("x"))
    p = F.col("x.starts") + 1
    return each.select(
        "row",
        "doc_id",
        F.col("x.found").alias("value"),
        F.col("x.starts").alias("start"),
        F.substr(F.col("text"), F.greatest(p - AROUND, F.lit(1)), F.least(p - 1, F.lit(AROUND))).alias("before"),
        F.substr(F.col("text"), p + F.length("x.found"), F.lit(AROUND)).alias("after"),
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, value, n_found, start, before, after): each text's distinct candidates with their first place.

    A row that repeats keeps its own candidates.
    """
    first = F.min_by(F.struct("doc_id", "start", "before", "after"), "start").alias("x")
    found = occurrences(docs, id_col, text_col).groupBy("row", "value").agg(F.count("*").cast("int").alias("n_found"), first)
    return found.select("x.doc_id", "value", "n_found", "x.start", "x.before", "x.after")


def scan(docs: DataFrame, model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's distinct candidates, as those of candidates(), with probability and is_secret.

    Every place is scored; start, before and after are those of the place of highest probability, the first of equals.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    found = with_features(occurrences(docs, id_col, text_col))
    found = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
    scored = model.transform(found).withColumn("probability", vector_to_array("probability")[1])
    best = F.max_by(F.struct("doc_id", "start", "before", "after", "probability"), F.struct("probability", -F.col("start"))).alias("x")
    out = scored.groupBy("row", "value").agg(F.count("*").cast("int").alias("n_found"), best)
    return out.select("x.doc_id", "value", "n_found", "x.start", "x.before", "x.after", "x.probability", (F.col("x.probability") >= threshold).alias("is_secret"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct candidate of every document with its probability; values as digests. Null and empty texts have none."""
    model = train(labelled_findings(spark))
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), model)
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.length("value").cast("long").alias("n_chars"), F.col("n_found").cast("long").alias("n_found"), F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), "is_secret")


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLE: dict[str, str] = {}
