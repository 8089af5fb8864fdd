"""Secret scan with false-positive removal by a random forest, in DataFrame functions only.

Candidates are runs of key characters with a digit in them, quoted or unbroken values of any length and characters that are
assigned to a word which announces a secret (in five languages), passwords inside addresses and those glued to a client's
option, found by one pattern. A random forest over candidate
length, character transitions, dictionary coverage, path signs and neighbouring words decides which of them are
secrets. Its dictionary is a short list of common words and, of the words inside candidates, those that stand by
themselves in ``DICTIONARY_DOCS`` or more of all documents.

The forest is trained from labelled findings: a table (value, before, after, label) given to ``train``, where a team has
one. ``labelled_findings`` makes one from general rules (tokens, passwords, pass phrases and access keys in their usual
settings against placeholders, digests in paths, card and phone numbers, addresses, identifiers, dates and repeated
characters), as no table of the input labels secrets.

Defined cases: null or empty text has no findings; null doc_id stays null; repeated rows each give their findings;
very long texts are scanned whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlespark.llm.common import cut, small, table, text_of

#: Words that announce a secret, in English, German, French, Spanish and Portuguese, words that announce something
#: else, and common letter groups.
SECRET_WORDS = (
    "token|secret|passw(?:or)?d?s?|pass.?phrase|passcode|(?<![A-Za-z])pass(?![a-z])|pwd|api.?key|apikey|auth|bearer|credentials?|access|private|access.?key|private.?key"
    "|passwort|kennwort|geheim(?:nis|wort)?|schl(?:ü|ue)ssel|mot.de.passe|motdepasse|mdp|contrase(?:ñ|n)a|clave|senha"
)
#: A run: 12 or more key characters with a digit that don't end in a full stop or the like.
RUN = r"(?<![A-Za-z0-9_/+.\-@])(?=[A-Za-z_/+.\-@]*+[0-9])[A-Za-z0-9_/+.\-@]{11,}[A-Za-z0-9_/+]"
#: An assigned value: what follows a name with an announcing word and a sign of assignment (or the attribute ``value`` after such a
#: name, or "is" before a quotation mark); the first look back is the cheap one.
SIGN = r"(?:[\"'\]]{0,2}[ \t]{0,4}(?::=|=>|={1,3}|:)|[\"'][ \t]{1,4}(?i:value)=)[ \t]{0,4}[\"']?"
ASSIGNED = rf"(?:(?<=[=:>][ \t]{{0,4}}[\"']?)(?<=(?i:{SECRET_WORDS})[A-Za-z0-9_\-]{{0,24}}{SIGN})|(?<=[ \t]is[ \t]{{1,4}}[\"'])(?<=(?i:{SECRET_WORDS})[ \t]{{1,4}}is[ \t]{{1,4}}[\"']))"
#: A password between a user and a host in an address, and one glued to the option of a database client.
IN_ADDRESS = r"(?<=://[^\s:/@\"']{1,64}:)[^\s:/@\"']++(?=@[A-Za-z0-9])"
OPTION = r"(?<=[ \t]-p)(?<=(?:mysql|mysqldump|mysqladmin|mariadb)[ \t][^\n]{0,80}-p)[^\s\"'\-][^\s\"']*+"
VALUE = r"(?:(?<=\")[^\"\r\n]++(?=\")|(?<=')[^'\r\n]++(?=')|(?![=:>])[^\s\"']*[^\s\"'.,;:)\]}])"
#: A candidate, with what stands before and after it for the neighbours' features.
CANDIDATE = f"{ASSIGNED}{VALUE}|{IN_ADDRESS}|{OPTION}|{RUN}"
BEFORE, AFTER = 48, 8
THRESHOLD = 0.5
OTHER_WORDS = "commit|sha1|sha256|md5|checksum|version|uuid|phone|tel|card|order|invoice|isbn|href|src|http|rev|digest|etag"
#: Letter groups that invented words are made of, and common words that always are in the dictionary.
GROUPS = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo za bra cle dri flo gro pla sto tri ent ion".split()
WORDS = (
    "able access account action after again all and any app archive back base battery beta big black blue book box build but button cache call "
    "client close cloud code color common config copy correct count data day debug default demo dev docs down east edit empty end error event "
    "example fast file final find first folder font form from full green group guest hand head help high home horse host hour house image index "
    "info input item job just key kind last left letter level light line link list local login long main make manual map master mode model month "
    "more mountain name new next night node note number office old open order other page paper part party path people place plan point prod "
    "public query queue read red release report result right river room root run sample save script search second server service session short "
    "side site small south sql stage staple start state station status step store street string style summer sun system table task team temp "
    "test text the time title tool top tree type under update user value version view water web week white wind window winter word work world year"
).split()
#: Documents that a word must stand in, by itself, to be in the dictionary.
DICTIONARY_DOCS = 5
FEATURES = [
    "length", "transitions", "digits", "uppers", "hexadecimal", "distinct", "covered", "path", "rooted", "extension", "dots", "at", "dashes",
    "longest_letters", "secret_word", "other_word", "assigned", "quoted", "known_prefix", "marks", "blanks", "placeholder", "in_address", "repeated",
]
#: Values that stand for a secret or say something about it.
PLACEHOLDERS = r"none|null|nil|true|false|yes|no|string|text|str|int|optional|required|public|private|basic|bearer|denied|granted|invalid|expired|missing|changed|empty|hidden|redacted|unknown|the|a|an|your.*|my.*|example.*|\$\{?[a-z_]+\}?|<[^>]*>|\{\{.*|\*+|x+|\.+|os\.(?:environ|getenv).*|process\.env.*|getenv.*|passwor[dt]|secret|token|user(?:name)?|changeit"
#: Findings made from rules for training, half of them secrets.
FINDINGS = 6_000
TREES, DEPTH, SEED = 40, 8, 7


def pieces(value: Column) -> Column:
    """The words inside a value: runs of letters of one case (or a capital and small ones), 3 letters or longer."""
    return F.transform(F.filter(F.regexp_extract_all(value, F.lit(r"\p{Lu}?\p{Ll}+|\p{Lu}+"), 0), lambda w: F.char_length(w) >= 3), F.lower)


def features(value: Column, before: Column, after: Column) -> list[Column]:
    """The forest's features of a candidate and its neighbours; the letters that the dictionary covers are in ``letters``."""
    n = F.char_length(value).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    runs = F.char_length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    low = F.lower(before)
    flag = lambda c: c.cast("double")
    share = lambda rest: F.char_length(F.regexp_replace(value, rest, "")) / n
    return [
        n.alias("length"), ((runs - 1) / n).alias("transitions"), share("[^0-9]").alias("digits"), share("[^A-Z]").alias("uppers"),
        flag(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")).alias("hexadecimal"), (F.size(F.array_distinct(F.split(value, ""))) / n).alias("distinct"),
        (F.col("letters") / n).alias("covered"), share("[^/]").alias("path"), flag(value.rlike(r"^(/|\.{1,2}/|~/|[A-Za-z]:[/\\]|[a-z]+://|www\.)")).alias("rooted"),
        flag(value.rlike(r"[/\\._-][^/\\]*\.[A-Za-z]{1,5}[0-9]?$|^[\w-]+\.[a-z]{2,4}$")).alias("extension"), share("[^.]").alias("dots"),
        flag(value.rlike(r"^[^@\s]+@[\w.-]+\.[a-z]{2,}$")).alias("at"), share("[^-_]").alias("dashes"),
        (F.array_max(F.transform(F.split(value, "[^A-Za-z]"), lambda x: F.char_length(x))) / n).alias("longest_letters"),
        flag(low.rlike(f"({SECRET_WORDS})([^a-z0-9]*|[\"'] +value=[\"']?| +is +[\"'])$")).alias("secret_word"), flag(low.rlike(f"({OTHER_WORDS})[^a-z0-9]*$")).alias("other_word"),
        flag(before.rlike(r"[=:]\s*[\"']?$")).alias("assigned"), flag(before.rlike("[\"']$") & after.rlike("^[\"']")).alias("quoted"),
        flag(value.rlike("^(AKIA|ASIA|ghp_|gho_|sk-|xox[abp]-|AIza|eyJ|glpat-)")).alias("known_prefix"),
        share(r"[A-Za-z0-9\s_/+.\-@]").alias("marks"), share(r"\S").alias("blanks"), flag(F.lower(value).rlike(f"^({PLACEHOLDERS})$")).alias("placeholder"),
        flag((before.rlike("://[^\\\\s:/@]+:$") & after.startswith("@")) | before.rlike(r"(mysql|mariadb)\S* .*-p$")).alias("in_address"), flag(value.rlike(r"(.)\1{5}")).alias("repeated"),
    ]


def candidates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to a row per candidate: id, doc_id, start (code points, from 0), value, before, after."""
    rows = docs.select("doc_id", text_of().alias("text")).where(F.col("text").rlike(CANDIDATE)).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "doc_id", F.split("text", CANDIDATE, -1).alias("parts"), F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("found"))

    def item(value: Column, i: Column) -> Column:
        before, after = F.element_at("parts", i + 1), F.element_at("parts", i + 2)
        return F.struct(i.alias("i"), F.char_length(before).cast("long").alias("gap"), value.alias("value"), F.substring(before, -BEFORE, BEFORE).alias("before"), F.substring(after, 1, AFTER).alias("after"))

    rows = rows.select("row", "doc_id", F.explode(F.transform("found", item)).alias("item")).select("row", "doc_id", "item.*")
    earlier = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # a text's candidates, without the text
    start = F.coalesce(F.sum(F.col("gap") + F.char_length("value")).over(earlier), F.lit(0)) + F.col("gap")
    return rows.select(F.struct("row", "i").alias("id"), "doc_id", start.alias("start"), "value", "before", "after")


def dictionary(spark: SparkSession, docs: DataFrame | None = None, found: DataFrame | None = None, least: int = DICTIONARY_DOCS) -> DataFrame:
    """Words (word): the fixed ones, and the words inside ``found`` values that stand by themselves in ``least`` or more of
    all ``docs``. Every document counts; only words that are asked for leave the scan."""
    fixed = spark.range(1).select(F.explode(F.array(*map(F.lit, WORDS))).alias("word"))
    if docs is None:
        return fixed
    asked = cut(found.select(F.explode(pieces(F.col("value"))).alias("word")).distinct())
    own = docs.select(F.explode(F.array_distinct(F.split(F.lower(text_of()), r"[^\p{L}\s]*\s+[^\p{L}\s]*"))).alias("word"))
    common = own.join(small(asked), "word", "left_semi").groupBy("word").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)
    return fixed.union(common.select("word")).distinct()


def with_letters(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found(id, value, ...)`` with ``letters``: how many letters of a value are in words of the dictionary."""
    hits = found.select("id", F.explode(pieces(F.col("value"))).alias("word")).join(small(words), "word")
    hits = hits.groupBy("id").agg(F.sum(F.char_length("word")).cast("double").alias("letters"))
    return found.join(hits, "id", "left").withColumn("letters", F.coalesce("letters", F.lit(0.0)))


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Labelled findings made from rules: id, value, before, after, label."""
    seed = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    pick = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(m)).cast("int")
    one_of = lambda salt, options: F.element_at(F.array(*[F.lit(o) if isinstance(o, str) else o for o in options]), pick(salt, len(options)) + 1)
    groups, known = F.array(*map(F.lit, GROUPS)), F.array(*map(F.lit, WORDS))
    invented = lambda salt: F.array_join(F.transform(F.sequence(F.lit(1), 2 + pick(salt, 3)), lambda i: F.element_at(groups, F.pmod(F.xxhash64(F.lit(salt), "id", i), F.lit(len(GROUPS))).cast("int") + 1)), "")
    common = lambda salt: F.element_at(known, pick(salt, len(WORDS)) + 1)
    parts = {salt: F.when(pick(salt + "?", 2) == 0, common(salt)).otherwise(invented(salt)) for salt in ("pa", "pb", "pc", "pd", "nb")}
    packed = F.regexp_replace(F.base64(F.unhex(seed("b"))), "[=]", "")
    numbers = F.concat(F.regexp_replace(seed("d"), "[^0-9]", ""), F.regexp_replace(seed("e"), "[^0-9]", ""))
    # what the rules below name many times is worked out once
    base = cut(spark.range(n).select("id", packed.alias("dense"), F.regexp_replace(packed, "[^A-Za-z0-9]", "").alias("plain"), numbers.alias("digits"), *[seed(k).alias(f"sha_{k}") for k in "acu"], *[w.alias(k) for k, w in parts.items()]))
    dense, plain, digits, word, hexed = F.col("dense"), F.col("plain"), F.col("digits"), F.col, lambda k: F.col(f"sha_{k}")
    title = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 99))
    some = lambda salt, a, b: F.substring(digits, F.lit(1) + pick(salt + "@", 8), F.lit(a) + pick(salt, b - a + 1))
    mark = lambda salt: one_of(salt, ["!", "$", "%", "#", "~", ":", "*", "&", "?"])
    tokens = one_of("s", [
        F.substring(hexed("a"), F.lit(1), 16 + pick("l", 25)), F.substring(hexed("a"), 1, 40), F.upper(F.substring(hexed("a"), 1, 40)), F.substring(dense, F.lit(1), 20 + pick("m", 20)), F.substring(plain, F.lit(1), 16 + pick("m", 20)),
        F.concat(F.lit("AKIA"), F.upper(F.substring(plain, 1, 16))), F.concat(one_of("pre", ["ghp_", "sk-", "glpat-", "xoxb-", "AIza"]), F.substring(plain, F.lit(1), 20 + pick("m", 17))),
    ])
    chosen = one_of("p", [
        F.concat(word("pa"), some("n", 1, 4)), F.concat(title(word("pa")), some("n", 1, 4), mark("ma")), F.concat(word("pb"), mark("ma"), word("pc"), some("n", 1, 4)),
        F.concat_ws(" ", word("pa"), word("pb"), word("pc"), word("pd")), F.concat_ws("-", word("pa"), word("pb"), word("pc"), word("pd")), F.concat(word("pa"), title(word("pb")), title(word("pc")), title(word("pd"))),
        F.translate(F.substring(dense, F.lit(1), 10 + pick("m", 26)), "0123456789+/", "ghijklmnopqr"), F.concat(F.substring(plain, F.lit(1), 4 + pick("n", 8)), mark("mb"), F.substring(plain, 20, 4)),
        F.concat(mark("mb"), F.substring(plain, F.lit(1), 6 + pick("n", 8)), mark("mc")), word("pa"), F.concat(word("pa"), word("pb")), F.concat_ws("_", word("pa"), word("pb"), some("n", 1, 2)),
        F.concat(word("pa"), some("n", 2, 3), word("pb")),
    ])
    announced = pick("kind", 5) < 2
    base = cut(base.withColumn("secret", F.when(announced, chosen).otherwise(tokens)))
    secret = F.col("secret")
    setting = one_of("t", ['token = "', "password=", "api_key: ", "secret='", "TOKEN = \"", "auth: ", "Bearer ", "access key ", "export API_TOKEN=", "SECRET_KEY='", "private_key: \"", "credentials: "])
    password = one_of("y", ['password = "', "password: '", "passwd=", "pwd: ", 'secret = "', "token: ", "api_key=", 'passphrase: "', "DB_PASSWORD=", "\"password\": \"", "pass_phrase => '", "redis_pass: ", "PGPASSWORD=", "passwort: ", "Kennwort: ", "mot de passe : ", "mdp=", 'contraseña = "', "clave: ", "senha=", '<add key="Password" value="', 'name="secret" value="'])
    setting = F.when(announced, F.when(secret.contains(" "), one_of("z", ['password = "', "secret: '", 'passphrase: "', 'pass phrase is "', 'Kennwort: "'])).otherwise(password)).otherwise(setting)
    setting = F.when(secret.rlike("^(AKIA|ghp_|sk-|glpat-|xoxb-|AIza)") & (pick("bare", 2) == 0), F.concat(word("nb"), F.lit(" "))).otherwise(setting)
    other = one_of("o", [
        some("c", 12, 19), F.concat_ws(".", some("i", 1, 3), some("j", 1, 3), some("k", 1, 3), some("l", 1, 3)), F.concat_ws("-", some("i", 3, 4), some("j", 3, 4), some("k", 4, 4), some("l", 4, 4)), F.concat(F.lit("+"), some("c", 11, 13)),
        F.concat(word("pa"), one_of("sep", [".", "_", ""]), some("n", 1, 4), F.lit("@"), word("pb"), one_of("dom", [".", "-"]), word("pc"), one_of("tld", [".com", ".org", ".net", ".de", ".fr", ".es"])),
        F.concat(one_of("root", ["/usr/", "/home/", "./", "https://www.", "src/", "lib/"]), word("pa"), F.lit("/"), word("pb"), some("n", 1, 2), one_of("ext", [".html", ".py", ".png", "/", ".js", ""])),
        F.concat(word("pa"), F.lit("_"), word("pb"), F.lit("_"), some("n", 1, 3)), F.concat(word("pa"), F.lit("-"), word("pb"), F.lit("-"), some("n", 1, 3), F.lit("."), some("m", 1, 2), one_of("ext", [".tar.gz", "", ".zip", ".whl"])), F.substring(hexed("c"), 1, 40), F.substring(hexed("c"), 1, 64),
        F.concat_ws("-", F.substring(hexed("u"), 1, 8), F.substring(hexed("u"), 9, 4), F.substring(hexed("u"), 13, 4), F.substring(hexed("u"), 17, 4), F.substring(hexed("u"), 21, 12)),
        F.concat(F.lit("20"), some("n", 2, 2), F.lit("-0"), some("m", 1, 1), F.lit("-1"), some("k", 1, 1), F.lit("T1")), F.concat(F.lit("000000"), F.repeat(some("n", 1, 1), 12)), F.concat(F.repeat(F.upper(F.substring(word("pa"), 1, 1)), 14), some("n", 1, 2)), F.concat(title(word("pa")), title(word("pb")), title(word("pc")), some("n", 1, 2)),
    ])
    told = one_of("e", [F.concat(F.lit("${"), word("pa"), F.lit("}")), F.concat(F.lit("<"), word("pa"), F.lit(">")), F.lit("********"), F.lit("xxxxxxxx"), F.concat(F.lit("your-"), word("pa"), F.lit("-here")), F.concat(F.lit("os.environ['"), F.upper(word("pa"))), F.concat(F.lit("{{ "), word("pa"), F.lit(" }}")), *PLACEHOLDERS.split("|")[:30]])
    by_name = F.concat(title(word("pb")), word("pc"))
    is_name = pick("i", 4) == 0
    addressed = announced & (pick("url", 8) == 0) & ~secret.rlike(r"[\s:/@]")
    setting = F.when(addressed, F.concat(one_of("sch", ["postgres://", "https://", "redis://", "see amqp://", "mysql -u "]), word("nb"), F.when(pick("sch", 5) == 4, F.lit(" -p")).otherwise(F.lit(":")))).otherwise(setting)
    base = cut(base.withColumn("other", F.when(announced, F.when(is_name, by_name).otherwise(told)).otherwise(other)))
    other = F.col("other")
    around = F.when(other.rlike("^[0-9a-f-]{36,64}$"), one_of("v", ["commit ", "sha1: ", "md5 ", "uuid=", "etag: ", "sha256:", "checksum ", "id: "])).otherwise(one_of("x", [F.concat(word("nb"), F.lit(" ")), F.concat(word("nb"), F.lit(", ")), "= ", "to: ", "(", F.concat(word("nb"), F.lit(": ")), F.concat(word("nb"), F.lit("=\"")), "see ", "from "]))
    around = F.when(announced, F.when(is_name, one_of("j", ["author: ", "authors: ", "authority: ", "accessed: "])).otherwise(password)).otherwise(around)
    good = F.pmod("id", F.lit(2)) == 0
    rows = base.select("id", F.when(good, secret).otherwise(other).alias("value"), F.when(good, setting).otherwise(around).alias("before"), good.cast("double").alias("label"))
    return rows.withColumn("after", F.when(F.col("before").endswith(":") & F.col("before").contains("://"), F.lit("@db.exam")).when(F.col("before").endswith('"'), F.lit('" ')).when(F.col("before").endswith("'"), F.lit("' ")).otherwise(one_of("w", [" and ", "\n", ", ", "", ") "])))


def train(findings: DataFrame, words: DataFrame | None = None):
    """A random forest fitted on ``findings(id, value, before, after, label)``, with a dictionary (by default the fixed
    words, so that the forest doesn't hang on the documents it is used on)."""
    words = dictionary(findings.sparkSession) if words is None else words
    findings = with_letters(cut(findings), words)  # kept, so that no feature works the rules out again
    rows = cut(findings.select("label", *features(F.col("value"), F.col("before"), F.col("after"))))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="x"), forest]).fit(rows)


def judged(found: DataFrame, model, words: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``found(id, value, before, after, ...)`` with the forest's probability and whether it is kept as a secret."""
    rows = with_letters(found, words).select("*", *features(F.col("value"), F.col("before"), F.col("after")))
    scored = model.transform(rows).withColumn("probability", vector_to_array("probability")[1])
    return scored.select(*found.columns, "probability", (F.col("probability") >= threshold).alias("is_secret"))


def scan(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """Every candidate of ``docs`` with its probability and whether it is kept as a secret."""
    found = cut(candidates(docs))
    words = cut(dictionary(docs.sparkSession, docs, found))
    return judged(found, model, words, threshold).select("doc_id", "start", F.char_length("value").alias("length"), "value", "probability", "is_secret")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents: place, length, a digest of the value, and the forest's probability."""
    found = scan(table(spark, sf_dir, "documents"), train(labelled_findings(spark))).where("is_secret")
    return found.select("doc_id", "start", "length", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "probability")
