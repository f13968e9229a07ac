"""Secret scan with a random forest against false positives, in DataFrame and SQL functions only.

A candidate is a run of 16 or more key-like characters that has a digit or mixes cases, or what is
assigned to a name with a secret word in it (``password = "..."``), from 6 characters on.  Its
features are length, character transitions, dictionary coverage, path marks, neighbouring words
and a few character shares.  A PEM block with a private key is a finding as a whole, by rule.  The forest is trained on labelled findings (:func:`labelled_findings`,
a bounded table), and its trees become nested CASE expressions, so that scoring is part of the
scan itself: no shuffle and no Python on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled rows, trees and depth of the forest; the share of trees that makes a finding.
ROWS, TREES, DEPTH, THRESHOLD, SEED = 6000, 15, 6, 0.5, 11
MARK = "[SECRET]"

#: Character class of keys, and word lists.
_CORE = "[A-Za-z0-9+/_.~-]{16,}={0,2}"
#: Names whose assigned values are candidates whatever they look like; quotes are written as \\x22 and \\x27.
_NAMED = r"(?i)(?:passw|passphrase|pwd|secret|token|api[_.-]?key|access[_.-]?key|private[_.-]?key|auth[_.-]?key|credential)[a-z0-9_.-]*[\x22\x27]?"
_ASSIGN = "(?:=>|:=|=|:)"
_VALUE = r"[^\s\x22\x27<>,;(){}\[\]`\x5c]{6,}"
_PEM = "(-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----)"
_SECRET_WORDS = "token|secret|passw|passphrase|pwd|api|apikey|auth|bearer|credential|private|access|key|client|signing"
_PLAIN_WORDS = (
    "commit|sha|hash|digest|checksum|md5|uuid|guid|revision|version|build|example|dummy|placeholder|sample|test|fixture"
    "|etag|trace|request|order|invoice|phone|card|href|src|image|base64|id"
)
_DICTIONARY = (
    "about|above|account|action|address|after|again|against|application|article|back|because|before|between|block|build"
    "|call|change|check|class|client|code|color|column|common|company|config|content|control|count|country|create|data"
    "|date|default|delete|design|device|document|domain|down|each|email|enter|error|event|example|factory|field|file"
    "|filter|first|form|format|from|function|general|group|handler|have|header|here|home|host|image|index|info|input"
    "|inter|internal|international|issue|item|java|label|language|large|level|library|line|link|list|local|main|manager"
    "|message|method|model|module|name|national|network|node|number|object|option|order|output|over|page|param|parent"
    "|part|path|place|please|point|post|print|process|product|program|project|public|query|read|record|report|request"
    "|resource|response|result|return|sample|schema|score|script|search|section|select|server|service|session|show|site"
    "|source|start|state|string|style|system|table|target|task|template|test|text|that|this|time|title|tool|type|under"
    "|update|user|utils|value|version|view|web|what|when|where|width|window|with|word|work|world|write|year|your"
)
_FEATURES = {
    "length": "double(length(x.core))",
    "transitions": "length(regexp_replace(x.core, '[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+', '.')) / length(x.core)",
    "dictionary": f"1 - length(regexp_replace(lower(x.core), '{_DICTIONARY}', '')) / length(x.core)",
    "path": "double(length(regexp_replace(x.word, '[^/@]', '')) + 3 * int(x.word rlike '://|www[.]|[.](com|org|net|html?|java|py|js|png|jpg|gif|pdf|txt)'))",
    "secret_words": f"double(int(lower(concat_ws(' ', x.before2, x.before1, x.lead)) rlike '{_SECRET_WORDS}'))",
    "plain_words": f"double(int(lower(concat_ws(' ', x.before2, x.before1, x.lead)) rlike '(^|[^a-z])({_PLAIN_WORDS})([^a-z]|$)'))",
    "after_words": f"double(int(lower(x.after1) rlike '(^|[^a-z])({_PLAIN_WORDS})([^a-z]|$)'))",
    "assigned": "double(int(concat(x.before1, x.lead) rlike '[=:>][ \"(]*$' or concat(x.before1, x.lead) rlike '[=:][^a-zA-Z0-9]*$'))",
    "quoted": r"""double(int(x.lead rlike r'[\x22\x27]$'))""",
    "digits": "length(regexp_replace(x.core, '[^0-9]', '')) / length(x.core)",
    "capitals": "length(regexp_replace(x.core, '[^A-Z]', '')) / length(x.core)",
    "distinct": "size(array_distinct(split(x.core, ''))) / least(length(x.core), 40)",
    "hex": "double(int(lower(x.core) rlike '^[0-9a-f]+$'))",
    "uuid": "double(int(lower(x.core) rlike '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}'))",
    "vowels": "length(regexp_replace(lower(x.core), '[^aeiou]', '')) / length(x.core)",
}
_STRUCT = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in _FEATURES.items()) + ")"


def labelled_findings(spark: SparkSession, rows: int = ROWS, first: int = 0) -> DataFrame:
    """``word, before1, before2, after1, label`` for ``rows`` findings made by rule from their number.

    Keys come from digests of the number, so rows from another ``first`` are held-out ones.
    """
    base = spark.range(first, first + rows, 1, 1).select(
        "id",
        F.sha2(F.concat(F.lit("a"), "id"), 256).alias("h"),
        F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), "id"), 512))), "[\r\n]", "").alias("b"),
        F.pmod(F.xxhash64("id"), F.lit(97)).alias("r"),
        F.pmod(F.col("id"), F.lit(32)).cast("int").alias("kind"),
    )
    w = base.select(
        "*",
        F.expr("element_at(array('the', 'of', 'und', 'les', 'para', 'to', 'and', 'harbour', 'que', 'value'), int(r % 10) + 1)").alias("p"),
        F.expr("element_at(array('token', 'api_key', 'secret', 'password', 'auth_token', 'access_key', 'client_secret', 'private_key'), int(r % 8) + 1)").alias("k"),
        F.expr("element_at(array('=', ':', '=>', ':='), int(r % 4) + 1)").alias("s"),
        F.expr("element_at(array('commit', 'sha', 'checksum', 'digest', 'revision', 'md5', 'hash', 'uuid'), int(r % 8) + 1)").alias("c"),
        F.expr("element_at(array('', '\"', ',', '.', ')', ';'), int(r % 6) + 1)").alias("t"),
    )
    w = w.select(
        "*",
        F.expr("element_at(array('password', 'passwd', 'db_password', 'secret', 'api_token', 'pwd', 'passphrase'), int(r % 7) + 1)").alias("n"),
        *(F.expr(f"element_at(split('{_DICTIONARY}', '[|]'), int(pmod(xxhash64(id, {i}), {_DICTIONARY.count('|') + 1})) + 1)").alias(x) for i, x in enumerate("deg")),
    )
    plain = "regexp_replace(b, '[^A-Za-z0-9]', '')"
    pick = lambda cases: F.expr("CASE kind " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END")
    words = [
        "concat('\"', substr(h, 1, 40), '\"', t)",
        "concat(k, '=\"', substr(h, 1, 32), '\"', t)",
        f"concat('\"', substr({plain}, 1, 24 + int(r % 20)), '\"', t)",
        f"concat(k, '=', substr({plain}, 1, 20 + int(r % 12)), t)",
        f"concat('AKIA', substr(upper({plain}), 1, 16), t)",
        f"concat('ghp_', substr({plain}, 1, 36), t)",
        f"concat('eyJ', substr({plain}, 1, 30), '.', substr({plain}, 10, 40), '.', substr({plain}, 20, 30))",
        "concat('\"', b, '\"', t)",
        "concat(k, ':', substr(h, 1, 40 + int(r % 24)))",
        f"concat('sk_live_', substr({plain}, 1, 24), t)",
        "concat('\"', substr(h, 1, 40), '\"')",
        f"concat('''', substr({plain}, 1, 32), '''', t)",
        f"concat(n, s, '\"', substr({plain}, 1, 8 + int(r % 6)), '!', r % 10, '\"', t)",
        f"concat('\"', lower(substr(regexp_replace(b, '[^A-Za-z]', ''), 1, 9 + int(r % 16))), '\"', t)",
        f"concat(n, s, substr({plain}, 1, 10 + int(r % 5)))",
        "concat('\"', d, e, g, d, '\"')",
        # and what only looks like it
        "concat(substr(h, 1, 40), t)",
        "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12), t)",
        "concat('https://www.example.com/', p, '/', substr(h, 1, 12), '/', r, 'index.html')",
        "concat('internationalConfig', 'Factory', 'Template', r, t)",
        "concat(repeat(substr(h, 1, 1), 12 + int(r % 30)), r, t)",
        "concat(p, '.', r, '@mail.example.com', t)",
        "concat(translate(substr(h, 1, 16), 'abcdef', '123456'), t)",
        "concat('\"YOUR_API_KEY_GOES_HERE_', r, '\"')",
        "concat(substr(h, 1, 64), t)",
        "concat('src/main/java/com/', p, '/', p, 'Manager', r, '.java')",
        "concat(d, e, g, d, e, r, t)",
        "concat(k, '=example-value-for-', p, '-', r)",
        "concat(n, s, d)",
        "concat('\"', d, '\"', t)",
        "CASE WHEN r % 3 = 0 THEN concat(d, '.', e) WHEN r % 3 = 1 THEN concat(d, t)"
        " ELSE translate(substr(h, 1, 6 + int(r % 7)), '0123456789abcdef', 'aeiounrstlmdcpbk') END",
        "concat(n, s, 'process.env.', upper(n))",
    ]
    before1 = ["s", "p", "s", "p", "s", "s", "'Bearer'", "s", "p", "s", "s", "s", "p", "s", "p", "s"]
    before1 += ["c", "'id'", "p", "p", "p", "p", "'card'", "s", "concat(c, ':')", "p", "p", "p", "p", "s", "concat(n, ':')", "p"]
    before2 = ["k", "p", "k", "p", "k", "k", "'Authorization:'", "k", "p", "k", "k", "k", "p", "n", "p", "n"]
    before2 += ["p", "p", "p", "p", "p", "p", "p", "k", "p", "'file'", "p", "p", "p", "n", "p", "p"]
    return w.select(
        pick(words).alias("word"),
        pick(before1).alias("before1"),
        pick(before2).alias("before2"),
        F.col("p").alias("after1"),
        (F.col("kind") < 16).cast("double").alias("label"),
    )


def _candidates(word: str, before1: str, before2: str, after1: str) -> str:
    """SQL for the candidates in one word: an array of structs."""
    runs = f"filter(regexp_extract_all({word}, '({_CORE})', 1), c -> c rlike '[0-9]|[a-z][A-Z]')"
    inside = f"""regexp_extract_all({word}, r'{_NAMED}{_ASSIGN}[\\x22\\x27]?({_VALUE})', 1)"""
    follows = (
        f"""({before1} rlike r'{_NAMED}{_ASSIGN}[\\x22\\x27]?$' OR ({before1} rlike r'^{_ASSIGN}$' AND {before2} rlike r'{_NAMED}$'))"""
    )
    after = f"""CASE WHEN {follows} THEN regexp_extract_all({word}, r'^[\\x22\\x27(]*({_VALUE})', 1) ELSE cast(array() as array<string>) END"""
    return (
        f"transform(array_union({runs}, array_union({inside}, {after})), c -> named_struct("
        f"'core', c, 'word', {word}, 'lead', substring({word}, 1, instr({word}, c) - 1),"
        f" 'before1', {before1}, 'before2', {before2}, 'after1', {after1}))"
    )


def featured(findings: DataFrame) -> DataFrame:
    """One row of features for the longest candidate of every labelled finding that has one."""
    return (
        findings.withColumn("c", F.expr(_candidates("word", "before1", "before2", "after1")))
        .where("size(c) > 0")
        .withColumn("x", F.expr("array_max(transform(c, y -> named_struct('n', length(y.core), 'y', y))).y"))
        .select("label", F.expr(_STRUCT).alias("f"))
        .select("label", "f.*")
    )


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> str:
    """A SQL expression over ``f.<feature>``: the share of trees that call the candidate a secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    names = list(_FEATURES)
    rows = VectorAssembler(inputCols=names, outputCol="v").transform(featured(findings).coalesce(1))
    forest = RandomForestClassifier(
        featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt"
    )
    model = forest.fit(rows)
    return "(" + " + ".join(_tree(t.toDebugString, names) for t in model.trees) + f") / {trees}D"


def _tree(text: str, names: list[str]) -> str:
    """The tree that MLlib prints, as nested CASE expressions."""
    rows = [x.strip() for x in text.splitlines()[1:] if x.strip()]

    def node(at: int) -> tuple[str, int]:
        found = re.match(r"If \(feature (\d+) <= ([-+\dEe.]+)\)", rows[at])
        if not found:
            return f"{float(rows[at].split(':')[1])}D", at + 1
        low, at = node(at + 1)
        high, at = node(at + 1)
        if low == high:
            return low, at
        return f"CASE WHEN f.{names[int(found[1])]} <= {float(found[2])!r}D THEN {low} ELSE {high} END", at

    return node(0)[0]


def _words(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+")


_NONE = "cast(array() as array<string>)"
_LITERAL = r"""concat(r'\Q', replace(s, r'\E', r'\E\\E\Q'), r'\E')"""
_INSIDE = "[A-Za-z0-9+/_.~-]"


def redact(text: str, findings: str) -> str:
    """SQL for ``text`` with ``MARK`` for every finding that stands there as a whole run, the longest first, in one pass."""
    longest = f"transform(reverse(array_sort(transform({findings}, s -> named_struct('n', length(s), 's', s)))), z -> z.s)"
    pattern = f"concat('(?<!{_INSIDE})(?:', array_join(transform({longest}, s -> {_LITERAL}), '|'), ')(?!{_INSIDE})')"
    mark = MARK.replace("$", r"\$")
    return f"CASE WHEN size({findings}) = 0 THEN {text} ELSE regexp_replace({text}, {pattern}, '{mark}') END"


def scan(docs: DataFrame, score: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with ``n_candidates``, ``findings`` (distinct secrets) and ``redacted``.

    ``redacted`` is the text with every finding replaced by ``MARK`` wherever it stands as a whole
    run of key-like characters, also where the forest saw no secret in its place: a string that is
    a secret once is one everywhere.  A null text has no candidates and stays null; an empty one stays
    empty; repeated rows get the same; an empty table stays empty.  Columns of ``docs`` with the three new
    names are replaced, all others stay.
    """
    score = score or train(labelled_findings(docs.sparkSession))
    near = lambda k: f"coalesce(get(words, i + {k}), '')"
    long = "length(words[i]) >= 16"
    # only texts that assign to a secret name somewhere have short candidates
    at = f"filter(sequence(0, size(words) - 1), i -> {long} OR (named AND length(words[i]) >= 6))"
    found = _candidates("words[i]", near(-1), near(-2), near(1))
    scored = f"transform(cands, x -> named_struct('core', x.core, 'f', {_STRUCT}))"
    secret = f"transform(filter(transform({scored}, z -> named_struct('core', z.core, 's', {score.replace('f.', 'z.f.')})), z -> z.s >= {threshold}D), z -> z.core)"
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    rows = docs.select(F.struct(*(F.col(quoted(c)).alias(f"_{i}") for i, c in enumerate(docs.columns))).alias("row"), F.col("text").alias("text"))
    rows = (
        rows.withColumn("words", _words("text"))
        .withColumn("named", F.expr(f"coalesce(text rlike r'{_NAMED}\\s*{_ASSIGN}', false)"))
        .withColumn("pem", F.expr(f"CASE WHEN contains(text, 'PRIVATE KEY-----') THEN regexp_extract_all(text, '{_PEM}', 1) ELSE {_NONE} END"))
        .withColumn("cands", F.expr(f"flatten(transform({at}, i -> {found}))"))
        .withColumn("n_candidates", (F.size("cands") + F.size("pem")).cast("long"))
        .withColumn("findings", F.expr(f"CASE WHEN n_candidates = 0 THEN {_NONE} ELSE array_union(pem, {secret}) END"))
        .withColumn("redacted", F.expr(redact("text", "findings")))
    )
    new = ["n_candidates", "findings", "redacted"]
    return rows.select(*(F.col(f"row._{i}").alias(c) for i, c in enumerate(docs.columns) if c not in new), *new)


def secret_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_candidates, n_findings, redacted_sha256`` for every row of ``docs``."""
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_candidates",
        F.size("findings").cast("long").alias("n_findings"),
        F.sha2(F.encode(F.coalesce("redacted", F.lit("")), "UTF-8"), 256).alias("redacted_sha256"),
    )
