"""Secret scans: candidates by form, false positives removed by a random forest.

A candidate is a run of at least 12 letters, digits and ``+ / _ -`` with both a
letter and a digit; a word may hold several.  The forest sees its length, shares of digits and capitals,
how often neighbouring characters change class, how many characters differ, how
much of it the trigrams of ordinary words cover, its share of vowels and longest
piece of letters (so words of no document are known as words), whether it looks like a path,
an address or a date, and the words beside it.  It is trained with labelled
findings: ``FINDINGS`` made-up secrets and look-alikes (checksums after
``commit`` or ``sha256``, identifiers, paths, timestamps, numbered words) set
among the most common words.  Words and trigrams are counted over all documents.  Its trees become one
SQL expression, so scanning is a projection without a shuffle: DataFrame and SQL
functions only.

Null and empty texts have no findings.  Rows with equal or no id are scanned one
by one.  An empty table gives no row (the forest is then trained with made-up
words).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import empty_if_null, store

#: Most common words that findings are made up of.
FIT_WORDS = 2_000
FINDINGS = 6_000
TREES, DEPTH = 15, 5
MASK = "[SECRET]"
WHITE = r"[\x20\x09-\x0D]+"
#: A whole run, however long: it is looked through once, from its beginning.
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{12,}"
#: Words that announce a secret or a checksum.
TELLING = "pass|pwd|secret|token|key|auth|credential|bearer"
HARMLESS = "commit|sha|md5|checksum|digest|hash|rev|version|build|file|path|uuid|page|date"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Syllables of look-alikes whose words stand in no document (any would do).
SYLLABLES = ["ba", "ce", "dor", "fi", "gan", "hel", "ji", "ko", "lum", "ma", "ner", "po", "qui", "ros", "su", "tel", "va", "win", "xo", "ze"]
FEATURES = ["length", "digits", "capitals", "changes", "distinct", "covered", "vowels", "longest", "hex", "separators",
            "address", "dated", "telling", "harmless", "assigned"]


def features(value: Column, word: Column, before: Column, after: Column, trigrams: str) -> dict[str, Column]:
    """The forest's inputs for a candidate in its word, with the two words before."""
    n = F.length(value).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    parts = F.regexp_extract_all(F.lower(value), F.lit("(?=([a-z]{3}))"), F.lit(1))
    pieces = F.regexp_extract_all(value, F.lit("[A-Z]?[a-z]+"), F.lit(0))
    bits = F.array(*[F.lit(trigrams[k : k + 676]) for k in range(0, 26**3, 676)])

    def known(part: Column) -> Column:
        digit = lambda k: F.instr(F.lit(LETTERS), F.substring(part, k, 1)) - 1
        return F.substring(F.get(bits, digit(1)), digit(2) * 26 + digit(3) + 1, F.lit(1)) == "1"

    near = F.lower(F.concat_ws(" ", before, word))
    return {
        "length": n,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "changes": share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(32.0)),
        "covered": F.size(F.filter(parts, known)) / n,
        "vowels": F.regexp_count(F.lower(value), F.lit("[aeiouy]")) / F.greatest(F.regexp_count(value, F.lit("[A-Za-z]")), F.lit(1)),
        "longest": F.coalesce(F.array_max(F.transform(pieces, F.length)), F.lit(0)) / n,
        "hex": value.rlike("^[0-9a-f]+$").cast("double"),
        "separators": F.regexp_count(word, F.lit(r"[/\\._-]")).cast("double"),
        "address": word.rlike("(?i)://|@|www[.]|[.](com|org|net|html?|php)").cast("double"),
        "dated": value.rlike("[0-9]{4}-[0-9]{2}|^[0-9/_-]+[A-Za-z]{1,3}[0-9/_-]*$").cast("double"),
        "telling": near.rlike(TELLING).cast("double"),
        "harmless": F.lower(before).rlike(HARMLESS).cast("double"),
        "assigned": F.concat_ws(" ", before, word).rlike("[=:\"']").cast("double"),
    }


def dictionary(docs: DataFrame, text_col: str) -> tuple[list[str], str]:
    """The most common words and the trigrams of ordinary words as 26**3 bits, of all
    documents.  Candidates are left out: where many secrets are, they would make
    every trigram an ordinary one."""
    text = F.regexp_replace(empty_if_null(text_col), RUN, " ")
    words = docs.select(F.explode(F.split(F.lower(text), "[^a-z]+")).alias("w")).where("length(w) > 2")
    counts = store(words.groupBy("w").agg(F.count("*").alias("n")), "secret_words")
    common = [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(FIT_WORDS).collect()] or ["the", "and", "value", "table"]
    places = F.sequence(F.lit(1), F.length("w") - 2)
    parts = counts.where("n > 1").select(
        F.explode(F.transform(places, lambda k: F.substring(F.col("w"), k, F.lit(3)))).alias("t"), "n"
    ).groupBy("t").agg(F.sum("n").alias("n")).where("n > 2")
    bits = ["0"] * 26**3
    for r in parts.collect():  # at most 26**3 rows
        a, b, c = (LETTERS.index(x) for x in r["t"])
        bits[a * 676 + b * 26 + c] = "1"
    return common, "".join(bits)


def labelled(spark: SparkSession, words: list[str], n: int = FINDINGS) -> DataFrame:
    """Made-up findings: value, word, before, after and label.  One range, whose rows
    choose their form: a plan for each form, with all words in it each time, would
    take hundreds of MB of the driver."""
    rnd = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 512)
    number = lambda salt, k: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(k)).cast("int")
    listed = F.split(F.lit(" ".join(words)), " ")  # words of letters
    pick = lambda salt: F.element_at(listed, number(salt, len(words)) + 1)
    of = lambda salt, items: F.element_at(F.array(*[F.lit(i) for i in items]), number(salt, len(items)) + 1)
    alnum = lambda salt: F.regexp_replace(F.base64(F.unhex(rnd(salt))), "[^A-Za-z0-9]", "")
    cut = lambda text, salt, low, high: F.substring(text, F.lit(1), number(salt, high - low + 1) + low)
    telling = ["password", "token", "secret", "api_key", "auth", "access_key", "pwd", "credential"]
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    plain = F.concat_ws(" ", a, b)
    made = lambda salt: F.concat(*[
        F.when(F.lit(k) < number(salt, 3) + 2, of(f"{salt}{k}", SYLLABLES)).otherwise("") for k in range(4)
    ])
    forms = [  # label, value, what stands before it in its word, words before
        (1, F.concat(F.lit("AKIA"), F.substring(F.upper(alnum("k")), 1, 16)), F.lit(""), plain),
        (1, cut(rnd("h"), "hl", 16, 48), F.concat(of("t", telling), of("e", ["=", ":"])), plain),
        (1, F.substring(rnd("h"), 1, 40), of("q", ['"', "'"]), F.concat_ws(" ", of("t", telling), of("e", ["=", ":"]))),
        (1, cut(alnum("s"), "sl", 20, 64), of("q", ["", '"']), F.concat_ws(" ", of("t", telling), of("e", ["=", ":", "is"]))),
        (1, F.concat(of("p", ["ghp_", "sk_live_", "xoxb-", "glpat-"]), cut(alnum("s"), "sl", 20, 40)), F.lit(""), plain),
        (1, cut(alnum("s"), "sl", 24, 64), of("q", ["", '"', "("]), plain),
        (0, F.concat(a, b, number("n", 9999).cast("string")), F.lit(""), plain),
        (0, F.concat_ws("-", a, b, c, (number("n", 90) + 1950).cast("string")), F.lit(""), plain),
        (0, F.concat_ws("/", a, b, F.concat(c, number("n", 99).cast("string"))), of("u", ["https://", "/", "./", "www.x.org/"]), plain),
        (0, F.substring(rnd("h"), 1, 40), of("q", ["", "(", ":"]), F.concat_ws(" ", a, of("v", ["commit", "sha256", "md5", "checksum", "digest", "hash"]))),
        (0, F.concat(F.lit("20"), F.lpad(number("n", 90).cast("string"), 2, "0"), F.lit("-0"), (number("m", 9) + 1).cast("string"), F.lit("-11T0"), number("o", 9).cast("string")), F.lit(""), plain),
        (0, F.concat(F.initcap(a), F.initcap(b), number("n", 99).cast("string"), F.initcap(c)), F.lit(""), plain),
        (0, F.concat(F.initcap(made("x")), F.initcap(made("y")), number("n", 99).cast("string"), F.initcap(made("z"))), F.lit(""), plain),
        (0, F.concat(made("x"), of("j", ["_", "-", "/"]), made("y"), of("j", ["_", "-", "/"]), made("z"), number("n", 999).cast("string")), F.lit(""), plain),
    ]
    each, form = n // len(forms), F.expr(f"id div {max(1, n // len(forms))}")
    rows = spark.range(0, each * len(forms), 1, 1).select(form.alias("form"), (form * n + F.col("id") % max(1, each)).alias("id"))
    rows = rows.select("form", "id", *[pick(salt).alias(salt) for salt in "abcd"])

    def chosen(part: int) -> Column:
        return F.coalesce(*[F.when(F.col("form") == k, F.lit(f[part])) for k, f in enumerate(forms)])

    rows = rows.select(
        chosen(0).cast("double").alias("label"), chosen(1).alias("value"), chosen(2).alias("lead"), chosen(3).alias("before"), F.col("d").alias("after")
    ).select("label", "value", F.concat("lead", "value").alias("word"), "before", "after")
    return rows.where(F.length("value") >= 12)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list, str]:
    """The trees, as nested (feature, threshold, left, right) or shares, and the trigrams."""
    words, trigrams = dictionary(docs, text_col)
    found = labelled(docs.sparkSession, words)
    columns = features(F.col("value"), F.col("word"), F.col("before"), F.col("after"), trigrams)
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(
        found.select("label", *[c.cast("double").alias(k) for k, c in columns.items()])
    )
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="sqrt").fit(data)

    def read(node) -> object:
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return stats[1] / max(sum(stats), 1e-9)
        split = node.split()
        return split.featureIndex(), split.threshold(), read(node.leftChild()), read(node.rightChild())

    return [read(t._java_obj.rootNode()) for t in forest.trees], trigrams


def _probability(trees: list, inputs: Column) -> Column:
    """Mean share of secrets over the trees, as one expression of a struct of features."""

    def walk(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        feature, threshold, left, right = node
        return F.when(inputs[FEATURES[feature]] <= threshold, walk(left)).otherwise(walk(right))

    total = walk(trees[0])
    for tree in trees[1:]:
        total = total + walk(tree)
    return total / len(trees)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, also where a lambda reads it for each item."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(s: Column, words: Column) -> Column:
    """Array of the runs of a word (at, value, near, before).  What stands near a
    run is its word, as far as the other runs and separators of fields; before a
    later run stand the characters between, with the run before if it is assigned."""
    earlier = lambda k: F.when(s["at"] >= k, F.get(words, s["at"] - k)).otherwise("")
    # There is one gap more than runs.
    cut = F.struct(
        F.regexp_extract_all(s["word"], F.lit(RUN), F.lit(0)).alias("runs"), F.split(s["word"], RUN).alias("gaps"),
        F.concat_ws(" ", earlier(2), earlier(1)).alias("before"),
    )

    def each(c: Column) -> Column:
        def one(value: Column, k: Column) -> Column:
            lead = F.get(c["gaps"], k)
            own = F.regexp_extract(lead, "[^?&;,{}|]*$", 0)
            tail = F.regexp_extract(F.get(c["gaps"], k + 1), "^[^?&;,{}|=]*", 0)
            name = F.when(lead.rlike("^[\"']?[:=]+[\"'(]*$"), F.get(c["runs"], k - 1)).otherwise("")
            return F.struct(
                s["at"].alias("at"), value.alias("value"), F.concat(own, value, tail).alias("near"),
                F.when(k == 0, c["before"]).otherwise(F.concat(name, own)).alias("before"),
            )

        return F.transform(c["runs"], one)

    return _once(cut, each)


def findings(text: Column, model: tuple[list, str]) -> Column:
    """Array of the findings of a text: word_no, secret and score."""
    trees, trigrams = model

    def candidates(words: Column) -> Column:
        numbered = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at")))
        likely = F.filter(numbered, lambda s: (F.length(s["word"]) >= 12) & s["word"].rlike(RUN))
        return F.flatten(F.transform(likely, lambda s: _runs(s, words)))

    def describe(s: Column) -> Column:
        inputs = features(s["value"], s["near"], s["before"], F.lit(""), trigrams)
        return F.struct(
            s["at"].cast("long").alias("word_no"), s["value"].alias("secret"), F.struct(*[c.alias(k) for k, c in inputs.items()]).alias("f")
        )

    def judge(s: Column) -> Column:
        return F.struct(s["word_no"].alias("word_no"), s["secret"].alias("secret"), _probability(trees, s["f"]).alias("score"))

    judged = F.transform(F.transform(_once(F.split(text, WHITE), candidates), describe), judge)
    found = F.filter(judged, lambda s: s["score"] >= 0.5)
    # Most texts hold no candidate at all and are not split into words.
    empty = F.array().cast("array<struct<word_no:bigint,secret:string,score:double>>")
    return F.when(text.rlike(RUN), found).otherwise(empty)


def kind(secret: Column) -> Column:
    return (
        F.when(secret.rlike("^AKIA[0-9A-Z]{16}$"), "cloud_key").when(secret.rlike("^[0-9a-f]+$"), "hex")
        .when(secret.rlike("^[a-z]{2,5}[_-]"), "prefixed").otherwise("other")
    )


def scan(docs: DataFrame, model: tuple[list, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per finding: doc_id, word_no (from 0), secret, kind and score."""
    model = model or fit(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), empty_if_null(text_col).alias("t"))
    found = rows.select("doc_id", F.explode(findings(F.col("t"), model)).alias("s"))
    return found.select("doc_id", "s.word_no", "s.secret", kind(F.col("s.secret")).alias("kind"), F.round("s.score", 6).alias("score"))


def redacted(docs: DataFrame, model: tuple[list, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, with the findings in texts masked; null texts stay null."""
    model = model or fit(docs, id_col, text_col)
    text = F.col(f"`{text_col}`").cast("string")
    # Longer ones first: a short secret may be part of a longer one.
    longest = F.array_sort(findings(text, model), lambda a, b: F.length(b["secret"]) - F.length(a["secret"]))
    masked = F.aggregate(longest, text, lambda t, s: F.replace(t, s["secret"], F.lit(MASK)))
    return docs.withColumn(text_col, F.when(text.isNotNull(), masked))
