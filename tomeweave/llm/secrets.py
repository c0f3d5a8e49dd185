"""Secret scanning: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of key characters, and shorter ones that are assigned
to a secret's name. A forest over their length,
character transitions, dictionary coverage, path signs and neighbouring words
decides which are secrets. It is trained from labelled findings, and then
written out as an expression, so scanning is one pass of DataFrame functions
over whole texts, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.base import with_matches
from tomeweave.scale import once

KEY_CHARACTERS = "A-Za-z0-9+/_-"
LEAST = 20
LEAST_NAMED = 6  # characters of a value that is assigned to a secret's name
NAMES = "secret|token|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private"
# The near look-behind is tried first: few places follow a sign, and only there a name is looked for.
NAMED = f"(?<=[=:][\\x20\\t]{{0,2}}[\"']?)(?<=(?i:{NAMES})[A-Za-z0-9_-]{{0,16}}[\"']?[\\x20\\t]{{0,2}}[=:][\\x20\\t]{{0,2}}[\"']?)"
SHORT = f"[A-Za-z0-9+/_!@#$%^&*.~-]{{{LEAST_NAMED - 1},}}[A-Za-z0-9+/_!@#$%^&*~-]"
CANDIDATE = f"(?<![{KEY_CHARACTERS}])(?:[{KEY_CHARACTERS}]{{{LEAST},}}+={{0,2}}|{NAMED}{SHORT})"
CONTEXT = 48  # characters looked at on either side
KEYWORDS = f"(?i)({NAMES})[^\\n]{{0,16}}$"
BENIGN = "(?i)(sha-?[0-9]+|md5|commit|checksum|etag|digest|hash|uuid|revision|integrity)[^\\n]{0,6}$"
PREFIXES = "^(gh[opsu]_|github_pat_|glpat-|AKIA|ASIA|AIza|sk[_-]|rk_live_|xox[abprs]-|eyJ|npm_|hf_)"
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
# A name that something is assigned to: words joined by signs, before an assignment sign that the run may end with.
NAME = "^[A-Za-z]+([_-]?[A-Za-z0-9]+)*$"
MASK = "[SECRET]"
FEATURES = (
    "length", "digits", "upper", "vowels", "distinct", "transitions", "hex", "covered", "separators", "path",
    "keyword", "benign", "assigned", "quoted", "prefix", "uuid", "name",
)


@dataclass(frozen=True)
class Settings:
    dictionary_words: int = 2_000  # most frequent words of all texts
    labelled_docs: int = 600  # documents whose words the seeded findings are set among
    trees: int = 16
    depth: int = 6
    threshold: float = 0.5
    seed: int = 11


# ------------------------------------------------------------------ features
def features(value: Column, before: Column, after: Column, dictionary: list[str]) -> list[Column]:
    """What the forest looks at, named as in ``FEATURES``; all are doubles."""
    n = F.greatest(F.lit(1), F.char_length(value))
    share = lambda keep: F.char_length(F.regexp_replace(value, f"[^{keep}]+", "")) / n
    runs = F.transform(F.regexp_extract_all(value, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0)), lambda w: F.lower(w))
    known = F.filter(runs, lambda w: w.isin(dictionary)) if dictionary else F.array().cast("array<string>")
    covered = F.aggregate(known, F.lit(0), lambda t, w: t + F.char_length(w)) / n
    turns = F.regexp_count(value, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])")) / n
    yes = lambda test: F.when(test, 1.0).otherwise(0.0)
    path = value.rlike("^[^/]*/[a-z0-9_-]*[a-z]{3}[a-z0-9_-]*/") | before.rlike("(?i)(://|[./\\\\])[^\\s]*$") | after.rlike("^\\.[a-z]{2,4}\\b")
    columns = [
        F.least(n, F.lit(256)).cast("double"), share("0-9"), share("A-Z"), share("aeiouAEIOU"),
        F.size(F.array_distinct(F.split(F.left(value, F.lit(64)), ""))) / F.least(n, F.lit(64)), turns, yes(value.rlike("^[0-9A-Fa-f]+$")),
        covered, share("/_=-"), yes(path), yes(before.rlike(KEYWORDS)), yes(before.rlike(BENIGN)),
        yes(before.rlike("[=:]\\s*[\"']?$")), yes(before.rlike("[\"']$") & after.rlike("^[\"']")),
        yes(value.rlike(PREFIXES)), yes(value.rlike(UUID)),
        yes((value.rlike(NAME.replace("$", "=$")) & after.rlike("^\\S")) | (value.rlike(NAME) & after.rlike("^[\"']?\\s*[:=]"))),
    ]
    return [c.cast("double").alias(name) for c, name in zip(columns, FEATURES, strict=True)]


def dictionary_of(docs: DataFrame, words: int, text_col: str = "text") -> list[str]:
    """The most frequent words of 3 to 20 letters over all texts; ``words`` of them reach the driver."""
    runs = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z]+")
    counted = docs.select(F.explode(once(runs)).alias("w")).where("length(w) between 3 and 20").groupBy("w").count()
    return [r["w"] for r in counted.orderBy(F.desc("count"), "w").limit(words).collect()]


# ------------------------------------------------------------------ training
def seeded_findings(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """(value, before, after, label): labelled findings set among the words of at most ``labelled_docs`` documents.

    Secrets are digests in several alphabets, after an assignment to a secret's
    name and also without any name: bare, with a known prefix, in URLs and
    headers; and short values after a name. False positives are joined words,
    slugs, paths, rulers, long numbers, identifiers and digests that are named as
    checksums, words behind a secret's name, and the long names themselves.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    leads = docs.select(F.left(text, F.lit(2_000)).alias("t")).where("length(t) >= 300").select("t", F.xxhash64("t").alias("h"))
    # Only hashes are sorted; texts are fetched for those taken, at most ``labelled_docs``.
    taken = [r["h"] for r in leads.select("h").distinct().orderBy("h").limit(settings.labelled_docs).collect()]
    some = leads.where(F.col("h").isin(taken)).dropDuplicates(["h"])
    w = F.filter(F.split(F.lower("t"), "[^a-z]+"), lambda x: F.length(x) > 1)
    rows = some.select("h", w.alias("w")).where("size(w) >= 24")
    digest = F.sha2(F.concat_ws("-", F.lit("seed"), F.col("h")), 256)
    base64 = F.base64(F.unhex(digest))
    lead = F.array_join(F.slice("w", 1, 4), " ")
    joined = lambda first, n, sep: F.array_join(F.slice("w", first, n), sep)
    names = [
        "token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret", "credential",
        "aws_secret_access_key", "PRODUCTION_API_TOKEN", "production_database_password", "GITHUB_PERSONAL_ACCESS_TOKEN",
    ]
    sums = ["sha256", "commit", "checksum", "md5", "etag", "digest", "integrity", "revision"]

    def pick(options: list[str], draw: int = 0) -> Column:
        by = F.xxhash64("h", F.lit(draw)) if draw else F.col("h")
        return F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(by, F.lit(len(options))) + 1).cast("int"))

    name, benign = pick(names), pick(sums)
    sign = pick(draw=1, options=[' = "', "=", ': "', ": ", "='"])
    closing = F.when(sign.rlike('"$'), '" ').when(sign.rlike("'$"), "' ").otherwise(" ")
    wide = F.upper(F.substring(digest, 3, 20))
    secret = [F.substring(digest, 1, 40), F.substring(digest, 1, 32), digest, F.regexp_replace(base64, "=+$", ""), wide]
    innocent = [
        (joined(6, 5, ""), F.concat(lead, F.lit(" ")), F.lit(" ")),
        (joined(5, 4, "-"), F.concat(lead, F.lit(" ")), F.lit(" ")),
        (joined(7, 5, "_"), F.concat(lead, sign), closing),
        (F.concat(F.lit("/"), joined(9, 5, "/")), F.concat(lead, F.lit(" ")), F.lit(".html ")),
        (F.repeat(pick(["-", "_", "/"]), 24), F.concat(lead, F.lit("\n")), F.lit("\n")),
        (F.translate(F.substring(digest, 1, 24), "abcdef", "012345"), F.concat(lead, F.lit(" ")), F.lit(" ")),
        (F.substring(digest, 1, 40), F.concat(lead, F.lit(" "), benign, F.lit(": ")), F.lit(" ")),
        (digest, F.concat(lead, F.lit(" "), benign, F.lit(" ")), F.lit(" ")),
    ]
    spaced, blank = F.concat(lead, F.lit(" ")), F.lit(" ")
    mixed = F.regexp_replace(base64, "=+$", "")
    alnum = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat_ws("-", F.lit("alnum"), F.col("h")), 512))), "[^A-Za-z0-9]+", "")
    named = F.concat(spaced, name, sign)
    # Passwords as they are made up: a word, digits and a word or a sign.
    capital = lambda k: F.initcap(F.element_at("w", k))
    made_up = F.concat(F.element_at("w", 6), F.regexp_replace(F.substring(digest, 5, 6), "[^0-9]", ""), pick(["7", "42", "1987"], 2), capital(7), pick(["", "!", "#9"], 3))
    bare = [
        (F.substring(digest, 9, 40), spaced, blank),
        (F.substring(mixed, 1, 40), spaced, blank),
        (F.substring(alnum, 1, 32), F.concat(spaced, pick(["(", "'", '"', ""], 4)), pick([") ", "' ", '" ', " "], 4)),
        (F.concat(pick(["ghp_", "glpat-", "sk_live_", "xoxb-", "npm_"], 5), F.substring(alnum, 5, 36)), spaced, blank),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(alnum, 3, 16))), spaced, blank),
        (F.substring(alnum, 7, 32), F.concat(spaced, F.lit("https://"), F.element_at("w", 9), F.lit(".example.com/"), F.element_at("w", 8), pick(["?key=", "?sig=", "/"], 6)), blank),
        (F.substring(mixed, 2, 36), F.concat(spaced, pick(["Authorization: Bearer ", "X-Key: ", "Cookie: session=", "Authorization: Basic "], 7)), pick(["\n", '" ', "; "], 8)),
    ]
    short = [
        (F.substring(alnum, 11, 14), named, closing),
        (made_up, named, closing),
        (F.substring(digest, 21, 16), named, closing),
    ]
    uuid = F.regexp_replace(F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    long_name = pick(names[8:], 9)
    innocent += [
        (uuid, F.concat(lead, pick([" id ", " ", ' id: "', "="], 10)), pick([" ", '" '], 11)),
        (F.element_at("w", 8), named, closing),
        (joined(9, 2, "-"), named, closing),
        (joined(6, 4, "_"), named, closing),
        (joined(8, 5, ""), named, closing),
        (F.concat(F.lit("/"), joined(10, 4, "/")), named, closing),
        (F.concat(long_name, F.lit("=")), spaced, F.concat(pick(["", '"', "'"], 12), mixed)),
        (long_name, spaced, F.concat(pick([' = "', ": ", '": "', " = "], 13), mixed)),
        (joined(7, 5, "_"), spaced, F.concat(pick([" = ", ": ", " "], 14), F.element_at("w", 3))),
    ]
    found = [F.struct(v.alias("value"), b.alias("before"), a.alias("after"), F.lit(1.0).alias("label")) for v, b, a in bare + short]
    found += [F.struct(v.alias("value"), F.concat(lead, F.lit(" "), name, sign).alias("before"), closing.alias("after"), F.lit(1.0).alias("label")) for v in secret]
    found += [F.struct(v.alias("value"), b.alias("before"), a.alias("after"), F.lit(0.0).alias("label")) for v, b, a in innocent]
    return rows.select(F.explode(F.array(*found)).alias("f")).select("f.*").where(
        (F.char_length("value") >= LEAST) | (F.col("before").rlike(f"{NAMED}$") & (F.char_length("value") >= LEAST_NAMED))
    )


Tree = tuple  # (feature, threshold, left, right), or (probability,) for a leaf


def train(findings: DataFrame, dictionary: list[str], settings: Settings = Settings()) -> list[Tree]:
    """A forest from labelled findings (value, before, after, label); rows with a null in them are left out.

    Without any findings nothing is known to be a false positive: every candidate scores 1.
    """
    clean = findings.dropna(subset=["value", "before", "after", "label"])
    if not clean.head(1):
        return [(1.0,)]
    rows = clean.select("label", *features(F.col("value"), F.col("before"), F.col("after"), dictionary))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    learner = RandomForestClassifier(
        numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed, featuresCol="features", labelCol="label"
    )

    def taken(node) -> Tree:
        if node.getClass().getSimpleName() == "LeafNode":
            return (float(node.impurityStats().prob(1.0)),)
        split = node.split()
        return (split.featureIndex(), float(split.threshold()), taken(node.leftChild()), taken(node.rightChild()))

    return [taken(tree._call_java("rootNode")) for tree in learner.fit(ready).trees]


def forest_score(found: Column, forest: list[Tree]) -> Column:
    """Mean of the trees' probabilities for a struct of features, as an expression."""

    def branch(tree: Tree) -> Column:
        if len(tree) == 1:
            return F.lit(tree[0])
        which, threshold, left, right = tree
        return F.when(found[FEATURES[which]] <= threshold, branch(left)).otherwise(branch(right))

    total = F.lit(0.0)
    for tree in forest:
        total = total + branch(tree)
    return total / len(forest)


def prepared(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> tuple[list[Tree], list[str]]:
    """A forest and a dictionary for these documents."""
    dictionary = dictionary_of(docs, settings.dictionary_words, text_col)
    return train(seeded_findings(docs, settings, text_col), dictionary, settings), dictionary


# ------------------------------------------------------------------ scanning
FOUND = "array<struct<start: int, end: int, value: string, score: double>>"


def _scored(docs: DataFrame, forest: list[Tree], dictionary: list[str], text_col: str) -> DataFrame:
    """``docs`` with _text, _gaps, _hits and ``_found``: every candidate with its place and score.

    What stands before and after a candidate is the text itself, also where another candidate is near. A
    candidate has ``LEAST_NAMED`` characters at least, so so many neighbours fill the context.
    """
    rows = docs.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = with_matches(rows, "_text", CANDIDATE, "_c")
    order = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_c_hits") - 1))
    reach = -(-CONTEXT // LEAST_NAMED)
    last = lambda c: F.right(c, F.lit(CONTEXT))
    first = lambda c: F.left(c, F.lit(CONTEXT))
    rows = rows.withColumns({
        "_heads": F.transform("_c_hits", lambda h, k: first(F.concat(first(h), first(F.get("_c_gaps", k + 1))))),
        "_tails": F.transform("_c_hits", lambda h, k: last(F.concat(last(F.get("_c_gaps", k)), last(h)))),
    })
    earlier = lambda k: F.array_join(F.slice("_tails", F.greatest(F.lit(1), k + 1 - reach), F.least(k, F.lit(reach))), "")
    later = lambda k: F.array_join(F.slice("_heads", k + 2, F.lit(reach)), "")
    near = F.transform(
        order,
        lambda k: F.struct(
            F.get("_c_hits", k).alias("value"), F.get("_c_starts", k).alias("start"),
            last(F.concat(earlier(k), last(F.get("_c_gaps", k)))).alias("before"),
            first(F.concat(first(F.get("_c_gaps", k + 1)), later(k))).alias("after"),
        ),
    )
    rows = rows.withColumn("_near", F.when(F.size("_c_hits") > 0, near))
    rows = rows.withColumn(
        "_near",
        F.transform("_near", lambda c: F.struct(c["start"].alias("start"), c["value"].alias("value"), *features(c["value"], c["before"], c["after"], dictionary))),
    )
    scored = F.transform(
        "_near",
        lambda c: F.struct(
            c["start"].alias("start"), (c["start"] + F.char_length(c["value"])).alias("end"), c["value"].alias("value"), forest_score(c, forest).alias("score")
        ),
    )
    return rows.withColumn("_found", F.coalesce(scored, F.array().cast(FOUND))).drop("_near", "_heads", "_tails")


def scan(docs: DataFrame, forest: list[Tree], dictionary: list[str], threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, candidates, secrets): arrays of start, end, value and score, for every row.

    Places are code points, the end is exclusive. A null or empty text has no
    candidates; ties of the score with the threshold count as secrets; repeated
    rows are scanned alike; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    found = _scored(rows, forest, dictionary, "_t")
    return found.select("doc_id", F.col("_found").alias("candidates"), F.filter("_found", lambda c: c["score"] >= threshold).alias("secrets"))


def masked(docs: DataFrame, forest: list[Tree], dictionary: list[str], threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by a mask; texts without one stay as they are, null ones too."""
    columns = docs.columns
    inner = docs.select(F.col(text_col).alias("_old"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    found = _scored(inner, forest, dictionary, "_old")
    kept = lambda k: F.when(F.get("_found", k)["score"] >= threshold, F.lit(MASK)).otherwise(F.get("_c_hits", k))
    rebuilt = F.array_join(F.transform("_c_gaps", lambda g, k: F.concat(g, F.coalesce(kept(k), F.lit("")))), "")
    changed = F.exists("_found", lambda c: c["score"] >= threshold)
    text = F.when(changed, rebuilt).otherwise(F.col("_old"))
    return found.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in columns])
