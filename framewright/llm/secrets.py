"""Secret scans: candidates by shape or by name, false positives removed by a random forest.

Words of SHORTEST characters or more are candidates by their shape; whatever is
assigned to a secret word, follows one or stands as a password in an address is a
candidate of any length and of any characters up to the next white space or, in
quotes, up to the closing one; so are passwords given as options of commands.  A
private key in its frame is one candidate over its lines.
Candidates, features and votes are expressions inside the document's row: no
shuffle, no Python, whatever the number of findings.  The words that a candidate
is compared with are those of most documents, counted once over the corpus.  The
forest is trained by MLlib on labelled findings (by default a bounded set that
generated() makes by rule from public formats), then read out as plain arrays, so
that scoring needs no model object.
"""

from __future__ import annotations

import hashlib
import json
import re
from base64 import b64encode
from hashlib import blake2b

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.decontaminate import with_chars
from framewright.llm.store import stored

#: Labelled findings the forest is trained on at most, trees and their depth.
FINDINGS, TREES, DEPTH = 8_000, 15, 9
#: Words of the corpus that the dictionary takes at most, and documents that must have a word.
COMMON, COMMON_DOCS = 2_000, 5
#: Shortest candidate by shape, and the share of votes from which it is a secret.
SHORTEST, THRESHOLD = 14, 0.5
MASK = "[SECRET]"

#: Words that name secrets (as features of words, and as names), commands with passwords as options, words that name harmless codes, prefixes of issued keys, and words that any dictionary has.
SECRET_WORDS = "token|secret|password|passwd|passphrase|pwd|api[_-]?key|apikey|access[_-]?key|private[ _-]?key|auth|bearer|credential"
#: A name of a secret begins where a word does, at a capital after a small letter, or anywhere if it says password; no other letters follow.
NAMES = (
    "(?:(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?:(?:[Tt]oken|[Ss]ecret|[Pp]assphrase|[Pp]wd|[Aa]pi[_-]?[Kk]ey|API[_-]?[Kk]ey|[Aa]ccess[_-]?[Kk]ey|[Pp]rivate[ _-]?[Kk]ey|[Aa]uth|[Bb]earer|[Cc]redentials?)(?![a-z])"
    "|(?:TOKEN|SECRET|PASSPHRASE|PWD|API[_-]?KEY|ACCESS[_-]?KEY|PRIVATE[ _-]?KEY|AUTH|BEARER|CREDENTIALS?)(?![A-Z]))|(?i:password|passwd)(?![a-zS]))"
)
COMMANDS = "sshpass|mysql|mysqldump|mariadb|curl|wget|htpasswd"
HARMLESS_WORDS = "sha1|sha256|sha512|md5|commit|checksum|digest|hash|uuid|guid|revision|etag|fingerprint|blob|example|sample|placeholder|card|phone|order|invoice|isbn|serial|session"
ISSUED = "^(AKIA|ASIA|AIza|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|npm_|pypi-|hf_|eyJ|SG[.])"
EMPTY_VALUES = "x{4,}|0{6,}|1234567|abcdefg|your|change|example|dummy|sample|placeholder|todo|none|null|redacted|test"
DICTIONARY = (
    "about access account action admin after array assets async base before binary block body bootstrap build button bytes cache call chain change check class click client code color column common component "
    "config connection container content context control count create current data date default delete demo directory document domain dummy element email enable entry error event example field file filter first "
    "font form format function global group handler header height hello home html http https icon image import index info input instance integer internal invoice item java javascript json kernel label language "
    "layout length level library line link list load local location lock login main manager master message method mock model module name network node number object offset open option order output package page "
    "param parent parser password path pattern phone placeholder plugin point policy post print process product profile project property public query random read record redirect register release remote render "
    "replace request reset resource response result return root route sample schema script search section secret select sequence server service session setting shared simple size source static status storage "
    "store stream string style summary support system table target task template test text theme time title token total tree type update upload user util value vendor version view widget width window with word "
    "work world write your"
).split()

#: Dictionary words that don't name secrets.
PLAIN = [w for w in DICTIONARY if not re.search(SECRET_WORDS, w)]

#: A private key in its frame; what an address has between a colon and the at sign.
_BLOCK = "(-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----[^-]++(?:-(?!----)[^-]*+){0,200}-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----)"
_KEY = "\u0001key\u0001"
_ADDRESS = "(?i)[a-z][a-z0-9+.-]*://[^\\s/:@]*:(?=([^\\s/@]+)@)"
#: A name of a secret in a word, with what may stand between it and a sign; a sign; a name at the end of a word; a word that only links.
_NAME = f"{NAMES}[\\w.-]*[\"'`)\\]]*"
_SIGN = "(?:[=:]+>?|->)"
_ASSIGNED = f"{_NAME}{_SIGN}(?=(.+))"
_NAMED = f"{_NAME}{_SIGN}?[\"'`]?$"
#: A quoted value of several words, its blanks while they hold it together, and the user before a password in an option.
_QUOTED = f"{_NAME}[ \\t]*{_SIGN}[ \\t]*([\"'`])([^\"'`\\n]*[ \\t][^\"'`\\n]*)\\1"
_BLANKS, _HELD = " \t", "\ufdd0\ufdd1"
_USER = "^[\"']?[^:/\\s]+:(.+)$"
_LINK = f"(?i)^(?:{_SIGN}|is|are|was)[\"'`]?$"
_CANDIDATE = r"[A-Za-z0-9_+/~-](?:[A-Za-z0-9_+/~.-]*[A-Za-z0-9_+/~-])?={0,2}"
FEATURES = (
    "length", "transitions", "digits", "upper", "hexadecimal", "distinct", "alternation", "dictionary", "path", "address",
    "secret_word", "harmless_word", "assigned", "quoted", "issued", "empty_value", "uuid", "test_path",
    "named", "signs",
)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _features(value: Column, before: Column, near: Column, after: Column, place: Column, named: Column, words: tuple[str, ...]) -> Column:
    """The features of a candidate, from itself, what its word has before it, the words around it, the path and the dictionary."""
    n = F.length(value)
    share = lambda chars: (n - F.length(F.regexp_replace(value, chars, ""))) / n
    classes = F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_~.=", "A" * 26 + "a" * 26 + "0" * 10 + "-" * 6)
    parts = F.filter(F.split(F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2")), r"[^\p{L}]+"), lambda w: F.length(w) > 2)
    # the dictionary is one value of the plan, not one for each word
    listed = F.lit(f" {' '.join(words)} ")
    known = F.filter(parts, lambda w: F.contains(listed, F.concat(F.lit(" "), w, F.lit(" "))))
    around = F.concat_ws(" ", near, before)
    return F.array(
        F.least(n, F.lit(200)).cast("double"),
        (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / n,
        share("[0-9]"),
        share("[A-Z]"),
        _flag(value.rlike("^[0-9a-fA-F]+$")),
        F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(32)),
        F.regexp_count(F.lower(value), F.lit("[bcdfghjklmnpqrstvwxz][aeiouy]")) * 2.0 / n,
        F.length(F.array_join(known, "")) / n,
        F.least(F.regexp_count(value, F.lit("[/.]")), F.lit(8)).cast("double"),
        _flag(before.rlike("@$|://|www[.]")),
        _flag(around.rlike(NAMES)),
        _flag(F.lower(F.concat_ws(" ", around, after)).rlike(HARMLESS_WORDS)),
        _flag(F.concat(near, before).rlike("[=:][\"'`]?$")),
        _flag(before.rlike("[\"'`]$")),
        _flag(value.rlike(ISSUED)),
        _flag(F.lower(value).rlike(EMPTY_VALUES)),
        _flag(value.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")),
        _flag(F.lower(place).rlike("test|spec|mock|fixture|example|docs?/")),
        _flag(named),
        share("[^A-Za-z0-9]"),
    )


def _value(rest: Column) -> Column:
    """What a text after a secret's name or sign gives as its value: what is quoted, or all without closing signs."""
    quoted = F.regexp_extract(rest, "^[=:>(\\[{]*([\"'`])(.+?)(?:\\1.*)?$", 2)
    return F.when(quoted != "", quoted).otherwise(F.regexp_replace(F.regexp_replace(rest, "^[=:>(\\[{\"'`]+", ""), "[,;.)\\]}>\"'`]+$", ""))


def _candidates(text: Column, place: Column, dictionary: tuple[str, ...]) -> Column:
    """Array of (value, word_no, features) of the candidates of a text: private keys, then others in order.  A value that a word has twice counts once."""
    framed = text.rlike("PRIVATE KEY(?: BLOCK)?-----")
    names = F.coalesce(text, F.lit("")).rlike(f"(?i){SECRET_WORDS}|{COMMANDS}")
    # a private key counts as one word, and so does a quoted value of a secret's name
    quoted = F.array_distinct(F.regexp_extract_all(text, F.lit(_QUOTED), F.lit(2)))
    held = F.aggregate(quoted, text, lambda t, v: F.replace(t, v, F.translate(v, _BLANKS, _HELD)))
    whole_text = F.when(text.rlike(_QUOTED), held).otherwise(text)
    words = F.split(F.coalesce(F.when(framed, F.regexp_replace(whole_text, _BLOCK, _KEY)).otherwise(whole_text), F.lit("")), "[ \\t-\\r]+")
    word_of = lambda all_words, i, k: F.coalesce(F.when(i + k >= 0, F.get(all_words, i + k)), F.lit(""))

    def raw(value: Column, word_no: Column, before: Column, near: Column, after: Column, named: Column) -> Column:
        return F.struct(value.alias("value"), word_no.alias("word_no"), before.alias("before"), near.alias("near"), after.alias("after"), named.alias("named"))

    def follows(i: Column, all_words: Column) -> Column:
        last, second = word_of(all_words, i, -1), word_of(all_words, i, -2)
        command = F.concat_ws(" ", *[word_of(all_words, i, -k) for k in (5, 4, 3, 2)]).rlike(COMMANDS)
        return last.rlike(_NAMED) | (last.rlike(_LINK) & second.rlike(_NAMED)) | (last.rlike("^(-p|--pass)$") & command)

    def users(w: Column, i: Column, all_words: Column) -> Column:
        return word_of(all_words, i, -1).rlike("^(-u|--user)$") & w.rlike(_USER)

    def of_word(w: Column, i: Column, next_one: Column, all_words: Column) -> Column:
        near = F.concat_ws(" ", word_of(all_words, i, -3), word_of(all_words, i, -2), word_of(all_words, i, -1))
        at = lambda v, rest: F.length(w) - F.length(rest) + F.position(v, rest) - 1
        none = F.array().cast("array<string>")
        option = F.when(users(w, i, all_words), F.array(F.regexp_extract(w, _USER, 1))).otherwise(none)
        rests = F.concat(F.regexp_extract_all(w, F.lit(_ADDRESS)), F.regexp_extract_all(w, F.lit(_ASSIGNED)), option, F.when(next_one & ~w.rlike(_LINK), F.array(w)).otherwise(none))
        named = F.filter(F.transform(rests, lambda r: _let(_value(r), lambda v: F.struct(at(v, r).alias("at"), v.alias("value"), F.lit(True).alias("named")))), lambda c: ~c["value"].isin("", _KEY))
        shaped = F.filter(F.regexp_extract_all(w, F.lit(f"({_CANDIDATE})")), lambda v: (F.length(v) >= SHORTEST) & v.rlike("[0-9]|.[A-Z]"))

        def both(by_name: Column) -> Column:
            others = F.filter(F.array_distinct(shaped), lambda v: ~F.exists(by_name, lambda c: c["value"] == v))
            return F.array_sort(F.array_distinct(F.concat(by_name, F.transform(others, lambda v: F.struct((F.position(v, w) - 1).alias("at"), v.alias("value"), F.lit(False).alias("named"))))))

        whole = lambda c: raw(F.translate(c["value"], _HELD, _BLANKS), i, F.substr(w, F.lit(1), c["at"]), near, word_of(all_words, i, 1), c["named"])
        return F.transform(_let(named, both), whole)

    def found(all_words: Column, names: Column) -> Column:
        def taken(w: Column, i: Column) -> Column:
            next_one = names & follows(i, all_words)
            named = names & (follows(i, all_words) | w.rlike(_ASSIGNED) | users(w, i, all_words)) | w.rlike(_ADDRESS)
            return F.when((F.length(w) >= SHORTEST) | named, F.struct(w.alias("w"), i.alias("i"), next_one.alias("next_one")))

        return F.flatten(F.transform(F.filter(F.transform(all_words, taken), lambda e: e.isNotNull()), lambda e: of_word(e["w"], e["i"], e["next_one"], all_words)))

    # bound once: within the words it would be taken again for each
    others = _let(F.struct(words.alias("words"), names.alias("names")), lambda t: _let(t["words"], lambda all_words: found(all_words, t["names"])))
    none, frame = F.lit(""), F.lit("private key")
    places = F.filter(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit(_KEY)), i)), lambda i: i.isNotNull())
    key = lambda v, at: raw(v, at, none, frame, none, F.lit(True))
    keys = F.filter(F.zip_with(F.regexp_extract_all(text, F.lit(_BLOCK)), places, key), lambda c: c["value"].isNotNull())
    every = _let(others, lambda o: F.when(framed, F.concat(keys, o)).otherwise(o))
    described = lambda c: F.struct(c["value"].alias("value"), c["word_no"].alias("word_no"), _features(c["value"], c["before"], c["near"], c["after"], place, c["named"], dictionary).alias("x"))
    return F.transform(every, described)


def common_words(docs: DataFrame) -> tuple[str, ...]:
    """The dictionary: DICTIONARY, and of the words of three letters or more those that most documents have, COMMON at most and none of under COMMON_DOCS documents.

    Words of one count (to three digits) are taken together or not at all, so that
    no task or driver orders all words.
    """
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), lambda w: (F.length(w) > 2) & (F.length(w) <= 24))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_DOCS)
    counts = stored(counts, "words")
    step = F.pow(F.lit(10.0), F.greatest(F.lit(0), F.floor(F.log10("n")) - 2))
    sizes = counts.groupBy((F.floor(F.col("n") / step) * step).cast("long").alias("least")).agg(F.count("*").alias("words"))
    least, words = 1 << 62, 0
    for r in sizes.orderBy(F.desc("least")).collect():  # about 900 counts for each power of ten
        words += r["words"]
        if words > COMMON:
            break
        least = r["least"]
    return tuple(sorted({*DICTIONARY, *(r["word"] for r in counts.where(F.col("n") >= least).collect())}))


def _finding(i: int, label: int, plain: list[str]) -> tuple[str, str]:
    """The i-th text with one finding, and its path."""

    def hashed(k: int, most: int) -> int:
        return int.from_bytes(blake2b(f"{k}-{i}".encode(), digest_size=8).digest(), "big") % most

    sha = lambda k, kind: getattr(hashlib, kind)(f"{k}-{i}".encode()).hexdigest()
    pick = lambda k, *of: of[hashed(k, len(of))]
    entry = lambda k, of=DICTIONARY: of[hashed(k, len(of))]
    count = lambda k, low, high: hashed(k, high - low + 1) + low
    number = lambda k, low, high: str(count(k, low, high))
    cut = lambda s, k, low, high: s[: count(k, low, high)]
    part = lambda s, at, n: s[at - 1 : at - 1 + n]
    join = lambda *of: "".join(of)
    joined_by = lambda sign, *of: sign.join(of)
    line = lambda *of: " ".join(of)
    title_of = lambda s: s[:1].upper() + s[1:].lower()

    hex40, hex32, hex64 = sha(1, "sha1"), sha(2, "md5"), sha(3, "sha256")
    base64 = b64encode(bytes.fromhex(sha(4, "sha384"))).decode().replace("=", "")
    letters = re.sub("[+/]", "Q", base64)
    digits = f"{hashed(5, 10**16):016d}"
    uuid = "-".join([part(hex32, 1, 8), part(hex32, 9, 4), part(hex32, 13, 4), part(hex32, 17, 4), part(hex32, 21, 12)])
    # invented words: consonants and vowels in turn
    syllable = lambda k: join(pick(k, *"bcdfghklmnprstvz"), pick(k + 100, *"aeiou"), pick(k + 200, "", "", "n", "r", "s"))
    spoken = join(*[syllable(k) for k in range(400, 404)], join(syllable(406), syllable(407)) if hashed(405, 2) else "")
    signs = lambda k: pick(k, *"!@#$%&*?^+")

    name = pick(10, "token", "secret", "password", "api_key", "auth_token", "access_key", "client_secret", "db_password", "credential", "apikey", "passwd", "DB_PASS_PASSWORD", "SECRET_KEY")
    title = pick(11, "password", "token", "secret", "passphrase", "credential", "passwd", "pwd")
    sign, quote = pick(12, "=", " = ", ": ", ":", " = "), pick(13, '"', "'", "", '"')
    set_to = lambda value: join(pick(14, name, title), sign, quote, value, quote)

    random = pick(20, cut(hex40, 21, 16, 40), cut(hex32, 21, 16, 32), cut(letters, 21, 14, 44), cut(base64, 21, 20, 60), hex40)
    mixed = cut(part(letters, 20, 44), 22, 6, 13)
    signed = join(cut(part(letters, 5, 9), 23, 2, 5), signs(24), cut(part(hex32, 7, 9), 25, 2, 5), signs(26), pick(27, "", part(digits, 3, 2), part(letters, 14, 5)))
    # passwords that people make: words, capitals, figures for letters, signs
    two, capital = join(entry(30, PLAIN), pick(31, "", "", "-", "_"), entry(32, PLAIN)), title_of(entry(30, PLAIN))
    made = pick(
        33, join(entry(30, PLAIN), number(34, 1, 9), entry(32, PLAIN)), join(two, entry(35, PLAIN), entry(36, PLAIN)), join(spoken, number(34, 1, 99)), join(capital, signs(37), number(34, 1, 9999)),
        join(capital, signs(37), title_of(entry(32, PLAIN)), number(34, 1, 99)).translate(str.maketrans("aeo", "430")), join(syllable(38), syllable(39), signs(37), number(34, 10, 9999)), join(spoken, syllable(40), syllable(41)),
    )
    human = pick(42, mixed, signed, made, made, cut(hex32, 43, 8, 13), part(letters, 9, 4))
    told = line(join(title, pick(44, "", " is", "", ":")), join(pick(45, mixed, signed, signed), pick(46, "", ".", "")))
    user = pick(50, "admin", "root", "user", "app", entry(51))
    host = join(pick(52, "db", "mail", "cache", entry(53)), ".", entry(54), pick(55, ".com:5432", ".org", ".internal:6379", ".net"))
    scheme = pick(56, "postgres", "mysql", "redis", "amqp", "https", "mongodb", "ftp")
    address = lambda password: join(scheme, "://", user, ":", password, "@", host, pick(57, "", "/", join("/", entry(58))))
    issued = pick(
        60, join(pick(61, "AKIA", "ASIA"), part(str.upper(letters), 1, 16)), join(pick(61, "ghp_", "gho_", "ghs_"), part(letters, 1, 36)), join("sk-", part(letters, 1, 48)), join("AIza", part(letters, 1, 35)),
        join("xoxb-", digits, "-", part(letters, 1, 24)), join("eyJ", part(letters, 1, 30), ".", part(base64, 1, 40)), join("glpat-", part(letters, 1, 20)), join("sk_live_", part(letters, 1, 24)), join("npm_", part(letters, 1, 36)),
    )
    frame = lambda kind, *body: "\n".join([f"-----BEGIN {kind}-----", *body, f"-----END {kind}-----"])
    lines = [part(b64encode(bytes.fromhex(sha(k, "sha512"))).decode(), 1, 64) for k in (62, 63, 64)]
    private = frame(pick(65, "PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"), *lines)
    bare = cut(letters, 67, 20, 40)

    harmless = pick(70, "commit", "sha256:", "md5", "checksum", "digest", "revision", "etag", "blob", "uuid", "hash")
    route = joined_by("/", entry(71), entry(72), entry(73), join(entry(74), number(75, 1, 99), pick(76, ".java", ".py", ".html", ".js", "")))
    camel = join(pick(99, "get", "set", "is", entry(71)), title_of(entry(72)), pick(100, "", title_of(entry(73)), title_of(join(syllable(412), syllable(413)))), pick(101, "", "ById", "Of", title_of(entry(74))), number(75, 1, 99))
    snake = joined_by("_", entry(71), entry(72), entry(73), number(75, 1, 999))
    mail = join(entry(71), ".", number(75, 1, 99), "@mail", number(77, 1, 9), ".example.com")
    site = join("https://www.", entry(71), number(75, 1, 99), ".example.org", pick(78, "", ":8080"), "/", route)
    build = joined_by("-", entry(71), entry(72), number(75, 100, 999), number(77, 1, 99))
    hollow = pick(79, "YOUR_TOKEN_HERE_1", "xxxxxxxxxxxxxxxx1", "0000000000000000", "example1234567890", "changeme12345678", "<your-api-key-1234>", "test_password_123", "dummySecretValue1")
    shouted = join(str.upper(join(spoken, syllable(408))), pick(80, "!!", "", "!", ".", "***"))
    joined = join(title_of(spoken), pick(81, "-", "/", "_", "."), title_of(join(syllable(409), syllable(410), syllable(411))))
    after = pick(82, "of", "in", "the", "for", "and", "to", "was", entry(83, plain), join(syllable(84), syllable(85)), join(syllable(84), syllable(85), syllable(86)))
    said = line(join(title, pick(87, "", "", "s", " is")), after)
    void = pick(88, "null", "none", "true", "false", "your_password", "changeme", "xxxxxx", "<password>", "example", "test", "todo", "***", "0", "1", entry(83, plain), entry(83, plain), join(syllable(84), syllable(85)), "the", "password", "${PASSWORD}", "$DB_PASSWORD", "os.environ")
    key = str.upper(join(entry(71), "_", entry(72)))
    code = pick(
        102, join(entry(71), ".", entry(72), "['", title_of(entry(73)), "-", title_of(entry(74)), "']"), join(entry(71), "(", entry(72), ")"), join("get", title_of(entry(71)), title_of(entry(72)), "()"), join("os.environ[\"", key, "\"]"),
        join("process.env.", key), join(entry(71), ".", entry(72), ".", entry(73)), join("new", " ", title_of(entry(71)), "()"), join("${", key, "}"), join("%(", entry(71), ")s"), join("{{ ", entry(71), ".", entry(72), " }}"),
    )
    phrase = line(*[pick(410 + k, entry(430 + k, PLAIN), syllable(440 + k), join(syllable(450 + k), syllable(460 + k))) for k in range(4)])
    sentence = line(pick(103, "enter", "your", "the", "please", "invalid", "a"), entry(104, plain), pick(105, "of", "for", "is", "to", "and", "in"), pick(106, "the", "your", "this", "a"), entry(107, plain))
    mark = pick(108, '"', "'", '"')
    quoted = lambda value: join(pick(14, name, title), pick(109, "=", " = ", ": "), mark, value, mark)
    option = pick(110, line("sshpass", "-p", join("'", human, "'")), line("curl", "-u", join(user, ":", human)), line("mysql", "-h", entry(54), "-p", human))
    folded = frame("RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED", join("DEK-Info: AES-128-CBC,", str.upper(hex32)), *lines)
    certificate = frame(pick(89, "CERTIFICATE", "PUBLIC KEY", "CERTIFICATE REQUEST"), *lines)

    positive = [set_to(human), set_to(human), told, set_to(random), set_to(random), issued, line(pick(90, "key", "login", "with"), issued), address(pick(91, human, random, human)), private, bare, quoted(phrase), option, folded]
    negative = [
        line(harmless, pick(92, hex40, hex32, hex64)), line(pick(93, "", "uuid", "order", "session", "id"), uuid), mail, site, route, camel, camel, snake, line(pick(94, "", "card", "invoice", "phone", "serial"), digits),
        set_to(hollow), pick(92, hex40, hex32, hex64), join(entry(71), ".", part(hex32, 1, 8), ".chunk.js"), build, shouted, shouted, joined, joined, said, said, said, set_to(void), set_to(void), set_to(void), address(void), certificate, certificate,
        set_to(code), set_to(code), set_to(code), quoted(sentence),
    ]

    # no secret words in the prose: what follows them would be labelled too
    prose = lambda k: line(*[pick(k + j, entry(k + j + 300, PLAIN), syllable(k + j + 320)) for j in range(3)])
    finding = pick(95, *positive) if label else pick(96, *negative)
    path = "tests/fixtures/a.txt" if not label and not hashed(97, 10) else pick(98, "src0", "src1", "web", "forum")
    return line(prose(500), finding, prose(510)), path


def generated(spark: SparkSession, rows: int = FINDINGS, words: tuple[str, ...] = (), first: int = 0) -> DataFrame:
    """``(text, path, label)``: labelled findings made by rule from hashes of row numbers (from the first on), each text with one finding.

    Secrets have the forms that issuers and configuration files publish: issued
    keys by their prefixes, random values and passwords assigned to names, told in
    prose, set in addresses or given as options, and private keys.  What isn't one
    are digests, identifiers, addresses, paths, numbers, placeholders, certificates,
    expressions of code, and the words that stand after a secret word in prose.
    Harmless words are taken from the dictionary of the corpus, ``words``, as well.

    The rows are a bounded value of the plan: as expressions of row numbers the
    forms took longer to compile than the whole scan of a small table takes.
    """
    plain = [*PLAIN, *(w for w in words if not re.search(SECRET_WORDS, w))]
    made = [{"text": text, "path": path, "label": float(i % 2)} for i in range(first, first + rows) for text, path in [_finding(i, i % 2, plain)]]
    every = F.from_json(F.lit(json.dumps(made)), "array<struct<text:string,path:string,label:double>>")
    return spark.range(1).select(F.explode(every).alias("r")).select("r.*")


class Forest:
    """Trees as parallel arrays: feature (-1 at a leaf), threshold, children, share of positives; roots; the dictionary of the features."""

    def __init__(self, trees, words: tuple[str, ...] = tuple(DICTIONARY)):
        self.words = words
        self.feature, self.threshold, self.left, self.right, self.share, self.roots = [], [], [], [], [], []
        for tree in trees:
            self.roots.append(self._add(tree))

    def _add(self, node) -> int:
        at = len(self.feature)
        stats = list(node.impurityStats().stats())
        for column, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, at), (self.right, at), (self.share, stats[1] / max(sum(stats), 1e-12))):
            column.append(v)
        if node.subtreeDepth():
            self.feature[at], self.threshold[at] = node.split().featureIndex(), node.split().threshold()
            self.left[at], self.right[at] = self._add(node.leftChild()), self._add(node.rightChild())
        return at

    def score(self, x: Column) -> Column:
        """The mean share of positives in the leaves that the features x reach."""
        of = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
        feature, threshold, left, right, share = of(self.feature, "int"), of(self.threshold, "double"), of(self.left, "int"), of(self.right, "int"), of(self.share, "double")
        step = lambda at, _: F.when(F.get(x, F.get(feature, at)) <= F.get(threshold, at), F.get(left, at)).otherwise(F.get(right, at))
        leaf = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), root, step)
        return F.aggregate(of(self.roots, "int"), F.lit(0.0), lambda s, root: s + F.get(share, leaf(root))) / len(self.roots)


_forests: dict[tuple, Forest] = {}


def train(findings: DataFrame, words: tuple[str, ...] = tuple(DICTIONARY), seed: int = 17) -> Forest:
    """A forest from labelled findings ``(text, path, label)``; every candidate of a text has its label.

    At most FINDINGS of them are taken, those of the smallest hashes, in that
    order, so that equal findings give an equal forest.  Nulls in text or label
    teach nothing; both labels must occur.
    """
    rows = findings.where("text is not null and label is not null").select("text", F.coalesce("path", F.lit("")).alias("path"), F.col("label").cast("double").alias("label"))
    chosen = rows.orderBy(F.xxhash64("text", "path", "label"), "text", "path", "label").limit(FINDINGS)
    flat = chosen.select(F.explode(_candidates(F.col("text"), F.col("path"), words)).alias("c"), "label")
    flat = stored(flat.select(*[F.get("c.x", F.lit(i)).alias(f) for i, f in enumerate(FEATURES)], "label"), "findings")
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(flat.coalesce(1))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="sqrt", subsamplingRate=0.8, seed=seed).fit(data)
    return Forest([t.rootNode() for t in model._java_obj.trees()], words)


def default_forest(docs: DataFrame) -> Forest:
    """The forest of the generated findings, trained with the dictionary of docs, with which it scores too; once per process and dictionary."""
    words = common_words(docs)
    key = (FINDINGS, TREES, DEPTH, words)
    if key not in _forests:
        _forests[key] = train(stored(generated(docs.sparkSession, words=words), "generated"), words)
    return _forests[key]


def found(docs: DataFrame, forest: Forest | None = None, path: str | None = "source") -> Column:
    """Array of (value, word_no, score) of the candidates of a row's text: private keys, then others in order, a value once per word.

    path names a column whose value stands for the place of the text, used where
    it exists.  Null and empty texts have no candidates.
    """
    forest = forest or default_forest(docs)
    place = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    return F.transform(_candidates(F.col("text"), place, forest.words), lambda c: F.struct(c["value"].alias("value"), c["word_no"].alias("word_no"), forest.score(c["x"]).alias("score")))


def findings(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """A row per candidate: doc_id, finding_no (0.. in the document), word_no, length, value_sha256, score, is_secret.

    The value itself isn't returned.  Documents without candidates have no row, nor
    has an empty table; repeated rows repeat their findings, and equal scores
    stand in order of the text; texts of any length are scanned whole, within
    their row; other columns are ignored.
    """
    rows = docs.select("doc_id", F.posexplode(found(docs, forest)).alias("finding_no", "f"))
    score = F.round("f.score", 6)
    return rows.select("doc_id", "finding_no", "f.word_no", F.length("f.value").alias("length"), F.sha2("f.value", 256).alias("value_sha256"), score.alias("score"), (score >= THRESHOLD).alias("is_secret"))


def redact(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """docs with every occurrence of a secret in its text replaced by [SECRET], of one under SHORTEST where no letter or digit adjoins.

    All rows and columns stay, n_chars is brought up to date.  Longer secrets are
    replaced first, equal ones once; null and empty texts and empty tables stay as
    they are; texts of any length are handled whole, within their row.
    """

    def masked(candidates: Column) -> Column:
        secrets = F.array_distinct(F.transform(F.filter(candidates, lambda c: F.round(c["score"], 6) >= THRESHOLD), lambda c: c["value"]))
        # longer secrets first: a shorter one may be part of them
        longest = F.reverse(F.sort_array(F.transform(secrets, lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))))
        # a secret under SHORTEST may be part of any word, and is replaced where it stands alone
        alone = lambda v: F.concat(F.lit("(?<![A-Za-z0-9])\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![A-Za-z0-9])"))
        return F.aggregate(longest, F.col("text"), lambda t, s: F.when(s["n"] < SHORTEST, F.regexp_replace(t, alone(s["v"]), F.lit(MASK))).otherwise(F.replace(t, s["v"], F.lit(MASK))))

    return with_chars(docs.withColumn("text", F.when(F.col("text").isNotNull(), _let(found(docs, forest), masked))))
