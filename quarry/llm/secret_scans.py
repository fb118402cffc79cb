r"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are white-space words that hold a long run with digits, or that follow or
contain the assignment of something named like a secret, and each such run and each
such assignment inside a word that has more to it (fields of JSON, query strings, CSV),
keys in a provider's form, and passwords in URLs. A forest judges each by its
length, its character transitions, how much of it dictionary words cover, the path
(the source of its document) and the neighbouring words. It is trained from labelled
findings; findings() makes such a table of the kinds of secrets and of look-alikes
that are publicly known, or a table of one's own may be given. Training takes
`most_findings` labelled rows at most; everything else covers all data.

Where a secret stands it is replaced, and nowhere else: where a field that is named, or a
password in a URL, is one, the word that it stands in is none as a whole; a word for a kind
of credentials ("Bearer") is none, and what follows it is looked at. The bodies of private
key blocks are known by their frame and replaced as a whole.

The trained trees become one Spark expression, and candidates are found and judged
inside their document's row by array functions, so a scan reads each text once,
shuffles nothing and runs no Python on the workers.

Defined cases: a null text has no candidate and stays null in redacted; repeated rows
each give a row; a null source is a path that says nothing; a candidate is judged where
it stands, so equal words may be judged differently; texts are scanned whole; an empty
table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from operator import add

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import quoted

#: ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
KEY = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|credential|(?:api|access|auth|private|secret)[_-]?key|auth)"
#: A run of 16 or more with a digit; the digit is looked for first, from the run's start.
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}"
ASSIGNED = KEY + r"[\w-]*[\"']?(?:=|:|=>)[\"']?[^\s\"']{6,}"
#: The fields of a word that holds several: what is assigned up to the next assignment, and runs with the name before them.
FIELD = (
    KEY + r"[\w-]*[\"']?(?:=>|:=|=|:)[\"']?(?:(?![&,;?{}|][\"']?[\w.-]{1,40}[\"']?[=:])[^\s\"']){6,}"
    r"|(?<![A-Za-z0-9+/_-])(?:[\w.-]{1,40}[\"']?(?:=>|:=|=|:)[\"']?)?(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}(?:\.[A-Za-z0-9+/_-]+){0,8}={0,2}"
)
#: A name with its sign, as in YAML, properties, headers or logs; the value is the next word.
NAMED = KEY + r"[\w-]*[\"']?(?::=|=>|=|:)[\"']?$"
#: What may stand between such a name and its value: a kind of credentials.
KIND = r"(?i)^[\"']?(?:bearer|basic|token|digest|negotiate|api-?key|hmac)$"
#: A field that says itself what it is.
SAID = rf"{KEY}[\w-]*[\"']?(?:=>|:=|=|:)[\"']?"
#: Public dictionary words that placeholders and identifiers are made of.
WORDS = (
    "access account address admin alpha api app array auth base beta bench branch build cache change char check class client code column "
    "commit config content copy count create data date debug default demo dev docs dummy edit email enter error event example fake field file "
    "filter first font foo from function get group hash header hello here home host html http id image import index info input insert item "
    "java key label last level lib line link list load local lock login main map message method mock model module name net new node null "
    "number object open option order org page param part pass password path place placeholder plugin point post private project public python "
    "query read redacted release remote remove request reset result root sample schema script search secret select server service session set "
    "sha size source spec src start state string style system table tag target task temp test text time title token tool tree type update "
    "upload url user util value version view web window word world write www xxxx your"
).split()
#: Neighbours that say what a look-alike is.
BENIGN = r"(?i)^[\W_]*(?:commit|sha-?1|sha-?256|sha-?512|md5|checksum|digest|etag|uuid|guid|revision|rev|hash|example|sample|version|build|id|isbn|doi)[\W_]*$"
TEST_PATH = r"(?i)(?:^|[/_.-])(?:tests?|spec|examples?|samples?|fixtures?|mocks?|docs?|demo)(?:$|[/_.-])"
PROVIDER = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[abprs]-|^sk-[A-Za-z0-9_-]{20,}$|^AIza[0-9A-Za-z_-]{35}$|^eyJ[A-Za-z0-9_-]{10,}|^glpat-[A-Za-z0-9_-]{20}$"
#: Such a key inside a word, digits or not.
PROVIDED = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20}|AIza[0-9A-Za-z_-]{35})"
#: A password in a URL, with the user before it.
IN_URL = r"://[^\s/:@\"']{1,80}:[^\s/:@\"']{6,}@"
#: A private key: the frame around its body.
BLOCK = r"(-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----)(?:(?!-----BEGIN )[\s\S])*?(-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----)"
FEATURES = ["length", "digits", "uppers", "marks", "transitions", "hexadecimal", "distinct", "dictionary", "provider", "shaped", "assigned", "benign", "test_path", "in_word"]


def rlike(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def is_candidate(word: Column, one: Column, two: Column) -> Column:
    """one and two: the words one and two places before, null where there are none."""
    marked = rlike(word, "[0-9=:]") & (rlike(word, RUN) | rlike(word, ASSIGNED) | rlike(word, IN_URL))
    return (F.length(word) >= 6) & (marked | rlike(word, PROVIDED) | (spaced(one, two) & ~rlike(word, KIND)))


def fields(word: Column) -> Column:
    """The word and those of its fields that hold another value than it, each once."""
    own = F.array_distinct(F.concat(*(F.regexp_extract_all(word, F.lit(p), F.lit(0)) for p in (FIELD, PROVIDED, IN_URL))))
    return F.concat(F.array(word), F.filter(own, lambda m: (value_of(m) != value_of(word)) & (F.length(value_of(m)) >= 6)))


def spaced(one: Column, two: Column) -> Column:
    """Whether the words before are the assignment of something named like a secret."""
    ends = F.coalesce(rlike(one, "[=:>][\"']?$"), F.lit(False))
    kind = F.coalesce(rlike(one, KIND) & rlike(two, NAMED), F.lit(False))
    return kind | ends & F.coalesce(F.when(one.isin("=", ":", "=>", ":="), rlike(two, KEY)).otherwise(rlike(one, NAMED)), F.lit(False))


def value_of(word: Column) -> Column:
    """What would be secret in a candidate: without the name it is assigned to, quotes and marks around it."""
    bare = F.when(rlike(word, f"^{IN_URL}$"), F.regexp_extract(word, "([^:]*)@$", 1)).otherwise(F.regexp_replace(word, r"^.*?(?:=>|=|:)(?=[\"']?[^\s\"'=:]{6})", ""))
    return F.regexp_replace(bare, r"^[^A-Za-z0-9+/_-]+|(?<=[A-Za-z0-9+/=_-])[\"'`].*$|[^A-Za-z0-9+/=_-]+$", "")


def features(word: Column, one: Column, two: Column, after: Column, path: Column) -> list[Column]:
    v = value_of(word)
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    without = lambda pattern: (F.length(v) - F.length(F.regexp_replace(v, pattern, ""))) / n
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]+", "\u0001"), "[A-Z]+", "\u0002"), "[0-9]+", "\u0003"), "[^\u0001-\u0003]+", "\u0004")
    near = lambda c, p: F.coalesce(rlike(c, p), F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return [
        F.length(v).cast("double"),
        without("[0-9]"),
        without("[A-Z]"),
        without("[A-Za-z0-9]") * -1 + 1,
        (F.length(runs) - 1) / n,
        flag(rlike(v, "^(?:[0-9a-f]+|[0-9A-F]+)$")),
        F.size(F.array_distinct(F.split(v, ""))) / n,
        (n - F.length(F.regexp_replace(F.lower(v), "|".join(sorted(WORDS, key=len, reverse=True)), ""))) / n,
        flag(rlike(v, PROVIDER)),
        flag(rlike(v, r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$|^\d{4}-\d\d-\d\d|^v?\d+\.\d+|^[\w./-]*/[\w./-]+$|^(.)\1{5,}")),
        flag(rlike(word, ASSIGNED) | rlike(word, IN_URL) | spaced(one, two)),
        flag(near(one, BENIGN) | near(two, BENIGN) | near(after, BENIGN) | rlike(word, r"(?i)(?:sha\d*|md5|commit|uuid|rev)[\"']?[=:]")),
        flag(rlike(path, TEST_PATH)),
        F.length(v) / F.greatest(F.length(word), F.lit(1)).cast("double"),
    ]


def findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(word, one, two, after, path, secret): n labelled findings, made by rule from digests of 0 .. n - 1."""
    d = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"), F.sha2(F.concat(F.lit("x"), F.col("id")), 256).alias("g"))
    base = F.regexp_replace(F.concat(F.base64(F.unhex("h")), F.base64(F.unhex("g"))), "[+/=]", "")
    upper = F.translate(F.upper(F.substring(base, 3, 60)), "0189", "2345")
    hexa = lambda k: F.substring("h", 1, k)
    dec = F.pmod(F.xxhash64("g"), F.lit(1000)).cast("string")
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.pmod(F.xxhash64("h"), F.lit(len(xs))) + 1).cast("int"))
    name = pick("password", "token", "api_key", "secret", "auth_token", "SECRET_KEY", "passwd", "access_key")
    prose = pick("the", "of", "and", "was", "with", "une", "der", "los", "is", "to", "an", "er")
    noun = F.element_at(F.array(*(F.lit(w) for w in WORDS)), (F.pmod(F.xxhash64("g"), F.lit(len(WORDS))) + 1).cast("int"))
    short = F.concat(F.substring(base, 4, 4), dec, F.substring(F.lower(base), 9, 3))
    glue = F.when(F.pmod(F.xxhash64("g", "h"), F.lit(3)) == 0, "=").otherwise(":")
    nothing = F.lit(None).cast("string")
    # word, one, two, label
    kinds = [
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), prose, prose, 1),
        (F.concat(F.lit('"'), hexa(40), F.lit('"')), F.lit("="), name, 1),
        (F.concat(name, F.lit("="), hexa(18)), prose, prose, 1),
        (F.concat(name, F.lit('="'), F.substring(base, 1, 32), F.lit('"')), prose, prose, 1),
        (F.concat(F.lit("ghp_"), F.substring(base, 1, 36)), prose, prose, 1),
        (F.concat(F.lit("sk-"), F.substring(base, 1, 48)), F.lit(":"), name, 1),
        (F.concat(name, F.lit(":"), F.substring(base, 5, 14)), prose, prose, 1),
        (F.concat(F.lit("'"), F.substring(base, 2, 40), F.lit("'")), F.lit("="), name, 1),
        (short, F.concat(name, glue), prose, 1),
        (F.concat(F.lit("AKIA"), F.substring(F.regexp_replace(upper, "[0-9]", ""), 1, 16)), prose, prose, 1),
        (F.concat(F.lit("glpat-"), F.substring(base, 1, 20)), prose, prose, 1),
        (F.concat(F.lit("'"), F.substring(base, 4, 3), pick("#", "!", "$", "%", "&"), F.substring(base, 8, 3), dec, F.lit("'")), F.concat(name, glue), prose, 1),
        (F.concat(name, F.lit("="), F.substring(F.lower(base), 3, 28)), prose, prose, 1),
        (F.concat(F.lit("://"), noun, F.lit(":"), short, F.lit("@")), prose, prose, 1),
        (F.concat(F.lit("://"), noun, F.lit(":"), noun, F.lit("_"), noun, F.lit("@")), prose, prose, 0),
        (F.concat(noun, F.lit("_"), noun), F.concat(name, glue), prose, 0),
        (F.concat(noun, F.lit(".")), F.concat(name, glue), prose, 0),
        (F.substring(F.translate("h", "0123456789", "ghiklmnoprstu"), 1, 9), F.concat(name, glue), prose, 0),
        (F.concat(F.lit("?"), noun, F.lit("="), prose, F.lit("&"), name, F.lit("="), F.substring(base, 1, 20), F.lit("&"), noun, F.lit("=de")), prose, prose, 0),
        (F.concat(noun, F.lit("://"), noun, F.lit(":"), short, F.lit("@"), noun, F.lit(".example")), F.lit("="), noun, 0),
        (hexa(40), pick("commit", "revision", "sha1", "Commit:"), prose, 0),
        (hexa(64), pick("sha256", "checksum", "digest", "sha256:"), prose, 0),
        (F.concat_ws("-", hexa(8), F.substring("g", 1, 4), F.substring("g", 5, 4), F.substring("g", 9, 4), F.substring("g", 13, 12)), pick("uuid", "id", "guid", "the", "of"), prose, 0),
        (F.concat(name, F.lit("=your_"), noun, F.lit("_"), name, F.lit("_here")), prose, prose, 0),
        (F.concat(F.lit("example_"), noun, F.lit("_"), name, F.lit("_"), dec), F.lit("="), name, 0),
        (F.concat(noun, F.lit("/"), noun, F.lit("_"), name, F.lit("/file_"), dec), prose, prose, 0),
        (F.concat(F.lit("2024-01-"), F.lpad(dec, 2, "0"), F.lit("T00_00_00_"), dec), prose, prose, 0),
        (F.concat(name, F.lit("="), F.repeat(F.lit("x"), 12), dec), prose, prose, 0),
        (F.concat(noun, F.lit("_"), noun, F.lit("_version_"), dec, F.lit("_"), noun), prose, prose, 0),
        (F.concat(F.repeat(dec, 7), dec), prose, prose, 0),
        (F.concat(name, F.lit("="), hexa(18)), pick("example", "sample"), prose, 0),
        (F.concat(F.lit('"'), hexa(40), F.lit('"')), F.lit("="), pick("commit", "digest", "etag", "checksum"), 0),
    ]
    which = F.pmod(F.col("id"), F.lit(len(kinds)))
    rows = F.element_at(F.array(*(F.struct(w.alias("word"), a.alias("one"), b.alias("two"), F.lit(y).cast("double").alias("secret")) for w, a, b, y in kinds)), (which + 1).cast("int"))
    # One secret in eight stands in the path of a test, and is none.
    made = d.select("id", rows.alias("r"), F.pmod(F.xxhash64("id"), F.lit(8)).alias("p"), prose.alias("after"))
    path = F.when(F.col("p") == 0, "tests/fixtures/keys").when(F.col("p") < 4, nothing).otherwise("src3")
    return made.select("r.word", "r.one", "r.two", "after", path.alias("path"), F.when(F.col("p") == 0, 0.0).otherwise(F.col("r.secret")).alias("secret"))


#: What a tree says, or the number of a feature, the most it may be for the first of two branches, and both.
type Tree = float | tuple[int, float, Tree, Tree]


def forest(labelled: DataFrame, trees: int = 20, depth: int = 7, seed: int = 11) -> list[str]:
    """Each tree, as SQL over an array `f` of FEATURES."""
    return [tree_sql(t) for t in trained(labelled, trees, depth, seed)]


def trained(labelled: DataFrame, trees: int = 20, depth: int = 7, seed: int = 11) -> list[Tree]:
    """Each tree, for an array of FEATURES."""
    x = labelled.select(*(c.alias(n) for c, n in zip(features(*(F.col(c) for c in ("word", "one", "two", "after", "path"))), FEATURES, strict=True)), "secret")
    model = RandomForestClassifier(labelCol="secret", numTrees=trees, maxDepth=depth, featureSubsetStrategy="0.6", seed=seed).fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(x))
    return [tree_of(t) for t in re.split(r"\n\s*Tree \d+.*?:\n", model.toDebugString)[1:]]


def tree_of(text: str) -> Tree:
    """From the text that the library prints for a tree."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]

    def node() -> Tree:
        line = lines.pop(0)
        if m := re.match(r"Predict: (\S+)", line):
            return float(m[1])
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        yes = node()
        lines.pop(0)  # Else
        return int(m[1]), float(m[2]), yes, node()

    return node()


def tree_sql(tree: Tree) -> str:
    if isinstance(tree, float):
        return f"{tree}D"
    k, most, yes, no = tree
    return f"CASE WHEN f[{k}] <= {most!r}D THEN {tree_sql(yes)} ELSE {tree_sql(no)} END"


def score(trees: list[Tree], f: Column) -> Column:
    """The share of trees that say so, for an array f of FEATURES.

    Made of columns: the parser would keep what it has learned from so long an SQL text in the driver's memory for good.
    """
    measure = [f[k] for k in range(len(FEATURES))]
    leaf = cache(F.lit)

    def of(tree: Tree) -> Column:
        if isinstance(tree, float):
            return leaf(tree)
        k, most, yes, no = tree
        return F.when(measure[k] <= leaf(most), of(yes)).otherwise(of(no))

    return reduce(add, map(of, trees)) / len(trees)


def bounded(labelled: DataFrame, most: int) -> DataFrame:
    """`most` rows at most, always the same ones: those with the least hashes."""
    own = labelled.select("word", "one", "two", "after", "path", "secret")
    return own.orderBy(F.xxhash64(*own.columns), *own.columns).limit(most)


def replaced(word: Column, values: Column) -> Column:
    """word with <secret> for each of these values, longer ones first, where no letter or digit of a longer run is next to it."""
    longest = F.transform(F.sort_array(F.transform(F.array_distinct(values), lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))), asc=False), lambda s: s["v"])
    edge = lambda v: F.concat(F.lit(r"(?<![A-Za-z0-9+/_-])\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![A-Za-z0-9+/_-])"))
    return F.aggregate(longest, word, lambda t, v: F.regexp_replace(t, edge(v), F.lit("<secret>")))


def judged(docs: DataFrame, labelled: DataFrame | None, most_findings: int, threshold: float, text_col: str, path_col: str) -> DataFrame:
    """row (all columns of docs), text, n_candidates, secrets and redacted."""
    spark = docs.sparkSession
    trees = trained(findings(spark, most_findings) if labelled is None else bounded(labelled, most_findings))
    rows = docs.select(F.struct(*quoted(docs)).alias("row"), F.col(text_col).cast("string").alias("text"), F.col(path_col).cast("string").alias("path"))
    words = rows.withColumn("words", F.split(F.coalesce("text", F.lit("")), SPACE, -1))
    word = lambda i, k: F.get("words", i + k)
    found = words.withColumn("places", F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: is_candidate(word(i, 0), word(i, -1), word(i, -2))))
    seen_of = lambda i, k, form: F.struct(i.alias("place"), value_of(form).alias("value"), F.when(k == 0, "whole").when(rlike(form, IN_URL) | rlike(form, f"^{SAID}"), "said").alias("kind"), F.array(*features(form, word(i, -1), word(i, -2), word(i, 1), F.col("path"))).alias("f"))
    known = found.withColumn("c", F.transform("places", lambda i: F.transform(fields(word(i, 0)), lambda form, k: seen_of(i, k, form)))).select("row", "text", "words", "c")
    scored = known.withColumn("c", F.transform("c", lambda w: F.transform(w, lambda x: F.struct(x["place"].alias("place"), x["value"].alias("value"), x["kind"].alias("kind"), score(trees, x["f"]).alias("score")))))
    over = F.transform("c", lambda w: F.filter(w, lambda x: (x["score"] > threshold) & (F.length(x["value"]) > 0)))
    # A field that is named says what is secret in its word, so a whole word that holds it isn't.
    held = lambda w, x: F.exists(w, lambda y: F.coalesce(y["kind"] == "said", F.lit(False)) & F.contains(x["value"], y["value"]) & (x["value"] != y["value"]))
    said = F.transform(over, lambda w: F.filter(w, lambda x: ~(F.coalesce(x["kind"] == "whole", F.lit(False)) & held(w, x))))
    bad = F.transform(F.filter(said, lambda w: F.size(w) > 0), lambda w: F.transform(w, lambda x: x.dropFields("kind")))
    secrets = scored.select("row", "text", "words", F.size(F.flatten("c")).cast("long").alias("n_candidates"), bad.alias("bad"))
    # Words with the white space behind them. What lies between two words with secrets is copied as it is.
    spaces = F.concat(F.regexp_extract_all("text", F.lit(SPACE), F.lit(0)), F.array(F.lit("")))
    whole = lambda a, b: F.array_join(F.slice(F.zip_with("words", spaces, lambda w, s: F.concat(w, s)), a + 1, b - a), "")
    place = lambda k: F.coalesce(F.get("bad", k)[0]["place"], F.size("words"))
    each = F.transform("bad", lambda w, k: F.concat(replaced(F.get("words", place(k)), F.transform(w, lambda x: x["value"])), F.get(spaces, place(k)), whole(place(k) + 1, place(k + 1))))
    redacted = F.when(F.size("bad") == 0, F.col("text")).otherwise(F.concat(whole(F.lit(0), place(F.lit(0))), F.array_join(each, "")))
    framed = F.when(F.contains("redacted", F.lit("-----BEGIN ")), F.regexp_replace("redacted", BLOCK, "$1<secret>$2")).otherwise(F.col("redacted"))
    return secrets.select("row", "n_candidates", F.flatten("bad").alias("secrets"), redacted.alias("redacted")).withColumn("redacted", framed)


def scan(docs: DataFrame, labelled: DataFrame | None = None, most_findings: int = 4000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (place of the word, what is secret, score) and redacted, for every document.

    redacted is the text with <secret> for each secret. The score is the share of trees that say so.
    """
    found = judged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(path_col).alias("source")), labelled, most_findings, threshold, "text", "source")
    return found.select("row.doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), "secrets", "redacted")


def redact(docs: DataFrame, labelled: DataFrame | None = None, most_findings: int = 4000, threshold: float = 0.5, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """docs, with <secret> for each secret in its texts."""
    found = judged(docs, labelled, most_findings, threshold, text_col, path_col)
    return found.select(*(F.col("redacted").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
