"""PII: detected entities get keyed, type-consistent surrogates.

Entities are found by one pattern, typed, and brought to a canonical form, so
that one phone number in two formats is one entity. A keyed digest of the
canonical form draws the surrogate: digits for digits, letters for letters of
the same case and script, card numbers with a valid check digit, names of the
gender that the title gives. A full name is drawn word by word, so "Mr Smith"
and "Mr John Smith" keep their common word, and a word of a name gets the same
surrogate where it recurs in its document without a title. Surrogates that meet each other or
a real entity are drawn again until all are distinct; from the fourth draw on
they grow, so that no format runs out of them. The mapping is per entity: the
same entity gets the same surrogate everywhere. Only DataFrame functions are
used.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, hot_keys, materialize, spread_join

# fixed values: titles by the gender that they state
MALE = ["Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Signora", "Госпожа", "Κυρία"]
NEUTRAL = ["Dr", "Prof", "Professor", "Doctor"]
CAPITALS = ["MR", "MRS", "MISS", "DR", "PROF", "HERR", "FRAU"]
# fixed values: syllables from which names are built, by script
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ja jo ka ke la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa we ya".split(),
    "cyrillic": "ба бе бо да де до га го ка ке ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва ве за зе".split(),
    "greek": "βα βε βο γα γε γο δα δε δο κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε".split(),
}
ENDINGS = {"latin": ("n", "na", "r", "l"), "cyrillic": ("н", "на", "в", "л"), "greek": ("ς", "νη", "ς", "λ")}
NAMES = ("given_m", "given_f", "given_n", "last")

_TITLE = r"(?=[MHSDFPГΚ])(?:" + "|".join(sorted(MALE + FEMALE + NEUTRAL + CAPITALS, key=len, reverse=True)) + r")\.?"
_WORD = r"\p{Lu}(?:['’]\p{Lu})?(?:\p{Ll}++(?:\p{Lu}\p{Ll}++)?|\p{Lu}++)"
_SECRET = r"(?i:password|passwd|pwd)[=:][\"']?"
_SPACED = r"(?i:password|passwd|pwd|secret|api[_-]?key|token)[\"']? {0,2}[=:] {0,2}[\"']?"
_HEX4 = r"[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,127}[A-Za-z]{2,}+(?![A-Za-z0-9])",
    "access": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    # the short look-behind fails at once nearly everywhere; a mask without letters and digits tells nothing
    "password": r"(?<=[=:\"'])(?<=" + _SECRET + r")(?=[^\s\"']*[\p{L}\p{N}])[^\s\"']++",
    # behind spaces, or of other names, only what holds a digit
    "secret": r"(?<=[=:\"'] {0,2})(?<=" + _SPACED + r")(?=[^\s\"']*\d)[^\s\"']{6,}+",
    "hex": r"(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    # three colons at least, so that code such as a::b stays
    "ipv6": r"(?<![\w:])(?:(?:" + _HEX4 + r":){7}" + _HEX4 + r"|(?=(?:[0-9A-Fa-f]{0,4}:){3})(?=[0-9A-Fa-f:]*\d)(?:" + _HEX4 + r"(?::" + _HEX4
    + r"){0,6})?::(?:" + _HEX4 + r"(?::" + _HEX4 + r"){0,6})?)(?![\w:])",
    "phone": r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d(?:[ .()-]{0,2}\d){7,14})(?!\w)",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?=(?:[ A-Z]*\d){10})(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "name": r"(?<!\p{L})" + _TITLE + r" " + _WORD + r"(?:[ -]" + _WORD + r")?(?!\p{L})",
}
PATTERN = "|".join(PATTERNS.values())
#: Every alternative holds one of these; a cheap test before the pattern itself.
HINT = r"@|AKIA|\d(?:\d\d|\.\d|\) |[ -]\d)|[0-9a-f]{32}|:[0-9A-Fa-f]{0,4}:|[PpSsAaTt](?i:assword|asswd|wd|ecret|pi[_-]?key|oken)[\"']? {0,2}[=:]|" + _TITLE + r" \p{Lu}"
#: Draws before surrogates start to grow.
STEADY = 4


def _letters(first: str, n: int) -> str:
    return "".join(chr(ord(first) + k) for k in range(n))


def _kind() -> Column:
    kind = F.lit("password")
    for name in ("name", "iban", "card", "ssn", "phone", "ipv6", "ip", "hex", "access", "email"):
        kind = F.when(F.col("value").rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(kind)
    return kind


def _digest(*parts: Column) -> Column:
    """512 hex digits drawn from the key and ``parts``."""
    joined = F.concat_ws("\u001f", *parts)
    return F.concat(*[F.sha2(F.concat(F.lit(f"{k}\u001f"), joined), 512) for k in range(4)])


def _byte(digest: str, at: str) -> str:
    return f"cast(conv(substring({digest}, 2 * pmod({at}, 256) + 1, 2), 16, 10) as int)"


def _same_class(value: str, digest: str) -> str:
    """SQL: every digit and letter of ``value`` by a drawn one of its script and case; the rest stays."""
    b = _byte(digest, "i")
    pick = lambda alphabet: f"substring('{alphabet}', 1 + {b} % {len(alphabet)}, 1)"
    cased = lambda test, low, up: f"when c rlike '{test}' then if(c = lower(c), {pick(low)}, {pick(up)})"
    return f"""array_join(transform(split({value}, ''), (c, i) -> case
        when c between '0' and '9' then chr(48 + {b} % 10)
        when c between 'a' and 'z' and kind in ('hex', 'ipv6') then chr(97 + {b} % 6)
        when c between 'A' and 'Z' and kind = 'ipv6' then chr(65 + {b} % 6)
        when c between 'a' and 'z' then chr(97 + {b} % 26)
        when c between 'A' and 'Z' then chr(65 + {b} % 26)
        when c <= '~' then c
        {cased("[\\\\p{IsCyrillic}&&\\\\p{L}]", _letters("а", 32), _letters("А", 32))}
        {cased("[\\\\p{IsGreek}&&\\\\p{L}]", _letters("α", 17), _letters("Α", 17))}
        when c rlike '\\\\p{{IsHan}}' then {pick(_letters("一", 256))}
        when c rlike '\\\\p{{Lu}}' then chr(65 + {b} % 26)
        when c rlike '\\\\p{{L}}' then chr(97 + {b} % 26)
        when c rlike '\\\\p{{N}}' then chr(48 + {b} % 10)
        else c end), '')"""


def _fill_digits(value: str, digits: str) -> str:
    """SQL: the digits of ``value`` replaced in turn by ``digits``; its format stays."""
    return f"""aggregate(split({value}, ''), struct('' as o, 0 as k), (s, c) ->
        if(c between '0' and '9', struct(concat(s.o, substring({digits}, s.k + 1, 1)) as o, s.k + 1 as k),
           struct(concat(s.o, c) as o, s.k as k)), s -> s.o)"""


def _fill(value: str, letters: str) -> str:
    """SQL: all but the spaces of ``value`` replaced in turn by ``letters``."""
    return f"""aggregate(split({value}, ''), struct('' as o, 0 as k), (s, c) ->
        if(c = ' ', struct(concat(s.o, c) as o, s.k as k),
           struct(concat(s.o, substring({letters}, s.k + 1, 1)) as o, s.k + 1 as k)), s -> s.o)"""


def _iban(country: str, account: str) -> str:
    """SQL: the number of ``account`` with its two check digits."""
    rest = f"""aggregate(split(concat({account}, {country}, '00'), ''), 0, (s, c) ->
        if(c between '0' and '9', (s * 10 + ascii(c) - 48) % 97, (s * 100 + ascii(c) - 55) % 97))"""
    return f"concat({country}, lpad(cast(98 - {rest} as string), 2, '0'), {account})"


def _luhn(digits: str) -> str:
    """SQL: the check digit that completes ``digits``."""
    d = "coalesce(try_cast(c as int), 0)"
    doubled = f"if({d} > 4, 2 * {d} - 9, 2 * {d})"
    return f"""cast(pmod(10 - aggregate(transform(split(reverse({digits}), ''), (c, i) -> if(i % 2 = 0, {doubled}, {d})), 0, (s, x) -> s + x) % 10, 10) as string)"""


def _name(token: str, digest: str) -> str:
    """SQL: a name in the script of ``token``: four syllables, more as it grows, and the ending of its kind."""
    out = "case"
    for script, range_ in (("cyrillic", "\\\\p{IsCyrillic}"), ("greek", "\\\\p{IsGreek}"), ("latin", "")):
        syllables = "array(" + ",".join(f"'{s}'" for s in SYLLABLES[script]) + ")"
        each = f"{syllables}[({_byte(digest, '2 * k')} * 256 + {_byte(digest, '2 * k + 1')}) % {len(SYLLABLES[script])}]"
        male, female, last, neutral = ENDINGS[script]
        ending = f"case kind when 'last' then '{last}' when 'given_f' then '{female}' when 'given_n' then '{neutral}' else '{male}' end"
        test = f"when {token} rlike '{range_}' then" if range_ else "else"
        out += f" {test} initcap(concat(array_join(transform(sequence(0, 3 + grown), k -> {each}), ''), {ending}))"
    out += " end"
    return f"if({token} = upper({token}), upper({out}), {out})"


def _secrets(spark: SparkSession, key: str) -> DataFrame:
    """One row per kind: kind, secret, domain_secret. As rows, not literals, they appear in no plan or event log."""
    secret = lambda of: hmac.new(key.encode(), of.encode(), hashlib.sha256).hexdigest()
    rows = [(kind, secret(kind), secret("domain")) for kind in (*PATTERNS, *NAMES)]
    return spark.createDataFrame(rows, "kind string, secret string, domain_secret string")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``entities(value, kind, canon, attempt)`` with their surrogate and its canonical form."""
    drawn = entities.join(F.broadcast(_secrets(entities.sparkSession, key)), "kind").withColumns({
        "dg": _digest(F.col("secret"), F.col("kind"), F.col("canon"), F.col("attempt").cast("string")),
        "dd": _digest(F.col("domain_secret"), F.lower(F.substring_index("value", "@", -1))),
        "digits": F.expr("regexp_replace(value, '[^0-9]', '')"),
        "grown": F.expr(f"greatest(attempt - {STEADY - 1}, 0)"),
    })
    n = "length(digits)"
    some = f"array_join(transform(sequence(1, greatest({n}, 1)), i -> chr(50 + {_byte('dg', 'i')} % 8)), '')"
    lead = "length(regexp_replace(regexp_extract(value, '^[+][0-9]{1,3}(?=[ .(-])', 0), '[^0-9]', ''))"
    drawn = drawn.withColumn("some", F.expr(some))
    drawn = drawn.withColumn("body", F.expr(f"concat(substring(digits, 1, 1), substring(some, 2, {n} - 2))"))
    luhn_ok = f"right(digits, 1) = {_luhn(f'left(digits, {n} - 1)')}"
    new_card = f"concat(body, if({luhn_ok}, {_luhn('body')}, right(some, 1)))"
    octets = "concat_ws('.', " + ",".join(f"cast(1 + ({_byte('dg', str(2 * k))} * 256 + {_byte('dg', str(2 * k + 1))}) % 254 as string)" for k in range(4)) + ")"
    local, host = "substring_index(value, '@', 1)", "substring_index(value, '@', -1)"
    top = f"substring_index({host}, '.', -1)"
    labels = f"left({host}, length({host}) - length({top}) - 1)"
    more = f"if(grown > 0, array_join(transform(sequence(1, grown), i -> chr(48 + {_byte('dg', '64 + i')} % 10)), ''), '')"
    compact = "replace(value, ' ', '')"
    account = f"concat({_same_class(f'substring({compact}, 5)', 'dg')}, {more})"
    surrogate = F.expr(f"""case kind
        when 'email' then concat({_same_class(local, 'dg')}, {more}, '@', {_same_class(labels, 'dd')}, '.', {top})
        when 'access' then concat('AKIA', {_same_class('substring(value, 5)', 'dg')}, {more})
        when 'password' then concat({_same_class('value', 'dg')}, {more})
        when 'hex' then concat({_same_class('value', 'dg')}, {more})
        when 'ipv6' then concat({_same_class('value', 'dg')}, {more})
        when 'iban' then {_fill(f'concat(value, {more})', _iban(f'left({compact}, 2)', account))}
        when 'ip' then concat({octets}, if(grown > 0, ':', ''), {more})
        when 'phone' then concat({_fill_digits('value', f'concat(left(digits, {lead}), substring(some, {lead} + 1))')}, {more})
        when 'ssn' then concat({_fill_digits('value', 'some')}, {more})
        when 'card' then concat({_fill_digits('value', new_card)}, {more})
        else {_name('value', 'dg')}
        end""")
    out = drawn.withColumn("surrogate", surrogate)
    return out.withColumn("new_canon", canonical(F.col("surrogate"))).select(*entities.columns, "surrogate", "new_canon")


def canonical(value: Column) -> Column:
    """The form in which two spellings of one entity are equal."""
    return (
        F.when(F.col("kind").isin("phone", "ssn", "card"), F.regexp_replace(value, "[^0-9]", ""))
        .when(F.col("kind") == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(F.col("kind").isin("email", "ipv6", *NAMES), F.lower(value))
        .otherwise(value)
    )


def _words(found: DataFrame) -> DataFrame:
    """The name words of ``found(value, kind)``: value, its words' kinds in order, and the mark between them."""
    word = F.split("value", "[ -]")
    title = F.lower(F.replace(word[0], F.lit("."), F.lit("")))
    given = F.when(title.isin([t.lower() for t in FEMALE]), "given_f").when(title.isin([t.lower() for t in NEUTRAL]), "given_n").otherwise("given_m")
    return found.where("kind = 'name'").select(
        "value",
        word[0].alias("title"),
        F.when(F.size(word) > 2, given).alias("given_kind"),
        F.when(F.size(word) > 2, word[1]).alias("given"),
        F.element_at(word, -1).alias("last"),
        F.when(F.col("value").contains("-"), "-").otherwise(" ").alias("mark"),
    )


def _drawn(entities: DataFrame, key: str, most_turns: int) -> DataFrame:
    """``entities(value, kind)`` with surrogates, distinct within each kind and none of them a real one."""
    first = entities.withColumns({"canon": canonical(F.col("value")), "attempt": F.lit(0)})
    drawn = materialize(surrogates(first, key))
    space = F.when(F.col("kind").isin(*NAMES), "name").otherwise(F.col("kind")).alias("space")
    for _ in range(most_turns):
        taken = drawn.groupBy("kind", "new_canon").agg(F.min("canon").alias("holder"))
        real = drawn.select(space, F.col("canon").alias("new_canon"), F.lit(True).alias("real")).distinct()
        again = (
            drawn.join(taken, ["kind", "new_canon"]).withColumn("space", space)
            .join(real, ["space", "new_canon"], "left")
            .where((F.col("holder") != F.col("canon")) | F.col("real"))
            .select("kind", "canon").distinct().withColumn("redo", F.lit(1))
        )
        again = materialize(again)
        if again.isEmpty():
            return drawn.select("value", "kind", "surrogate")
        next_ = drawn.join(again, ["kind", "canon"], "left").select(
            "value", "kind", "canon", (F.col("attempt") + F.coalesce("redo", F.lit(0))).alias("attempt")
        )
        after = materialize(surrogates(next_, key))
        drop_table(drawn, again)
        drawn = after
    raise RuntimeError("surrogates still collide, though they grow with every turn")


def mapping(values: DataFrame, key: str, most_turns: int = 100) -> DataFrame:
    """One row per distinct ``value``: kind and surrogate, all surrogates distinct.

    Entities of one canonical form share a surrogate up to format. A surrogate
    drawn for two entities, or equal to a real one, is drawn again for all but
    the first of them.
    """
    found = materialize(values.select("value").withColumn("kind", _kind()))
    words = _words(found)
    spelled = words.select(F.explode(F.array(
        F.struct(F.col("given").alias("value"), F.col("given_kind").alias("kind")),
        F.struct(F.col("last").alias("value"), F.lit("last").alias("kind")),
    )).alias("w")).select("w.*").where("value is not null").distinct()
    drawn = _drawn(found.where("kind <> 'name'").unionByName(spelled), key, most_turns)
    own = drawn.where(~F.col("kind").isin(*NAMES))
    part = lambda name: drawn.select(F.col("value").alias(name), F.col("kind").alias(f"{name}_kind"), F.col("surrogate").alias(f"new_{name}"))
    named = (
        words.join(part("given"), ["given", "given_kind"], "left")
        .withColumn("last_kind", F.lit("last")).join(part("last"), ["last", "last_kind"])
    )
    new = F.concat("title", F.lit(" "), F.concat_ws("", F.concat("new_given", "mark"), F.col("new_last")))
    return own.unionByName(named.select("value", F.lit("name").alias("kind"), new.alias("surrogate")))


def _known(value: Column, surrogate: Column) -> Column:
    """The words of a name with their surrogates, lower-cased and from the apostrophe on."""
    after = lambda name: F.slice(F.split(name, "[ -]"), 2, 2)
    bare = lambda word: F.lower(F.regexp_replace(word, "^.*['’]", ""))
    return F.zip_with(after(value), after(surrogate), lambda w, s: F.struct(bare(w).alias("word"), F.initcap(s).alias("new")))


def _recurring(part: Column, known: str) -> Column:
    """``part`` of a text with the capitalised words in ``known`` replaced; its other words stay."""
    heads = F.transform(
        F.split(part, r"(?<!\p{L})(?=\p{Lu})", -1),
        lambda p: F.struct(p.alias("p"), F.regexp_extract(p, r"^\p{Lu}\p{L}*+", 0).alias("head")),
    )
    found = F.transform(heads, lambda x: F.struct(x.p.alias("p"), x.head.alias("head"), F.array_position(f"{known}.word", F.lower(x.head)).cast("int").alias("at")))
    new = lambda x: F.element_at(f"{known}.new", x["at"])
    cased = lambda x: F.when(x.head == F.upper(x.head), F.upper(new(x))).otherwise(new(x))
    word = lambda x: F.concat(cased(x), F.substr(x.p, F.length(x.head) + 1))
    return F.array_join(F.transform(found, lambda x: F.when(x["at"] > 0, word(x)).otherwise(x.p)), "")


def replace_entities(
    docs: DataFrame, key: str, report: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, with every entity of the text replaced by its surrogate.

    ``key`` is the secret of the mapping; whoever has it can test guesses. With
    ``report`` two columns follow: n_entities, and kinds, the distinct kinds
    found, sorted and comma-joined; columns of these names give way to them.
    Null texts stay null, texts without entities stay as they are, masks such
    as ``****`` too. Repeated rows and null ids stay. Names count behind a
    title of the lists above; their words are replaced wherever they recur
    capitalised in the document, which n_entities does not count.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    added = {"n_entities", "kinds"} if report else set()
    names = [c for c in docs.columns if c not in added]
    rest = F.struct(F.lit(0), *[F.col(c) for c in names if c != text_col])
    rows = docs.select(F.col(text_col).alias("text"), rest.alias("rest"))
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    without = rows.where(~(hinted & F.coalesce(F.col("text").rlike(PATTERN), F.lit(False)))).select(
        "text", "rest", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds")
    )
    # the row number keeps the filter above the extraction, which thus runs once; stored, it names the row
    some = rows.where(hinted).select(
        F.monotonically_increasing_id().alias("doc"), "text", "rest", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found")
    )
    some = materialize(some.where(F.size("found") > 0).withColumn("between", F.split("text", PATTERN, -1)).drop("text"))
    met = some.select("doc", F.explode(F.array_distinct("found")).alias("value"))
    counts = materialize(met.groupBy("value").agg(F.count("*").alias("m")))
    placed = spread_join(met, materialize(mapping(counts, key)), "value", hot_keys(counts, "value", "m"), "doc")
    of_doc = placed.groupBy("doc").agg(
        F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias("names"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(
            F.when(F.col("kind") == "name", _known(F.col("value"), F.col("surrogate")))
        )))).alias("known"),
    )
    new = F.transform("found", lambda v: F.element_at("names", v))
    between = F.when(F.size("known") > 0, F.transform("between", lambda p: _recurring(p, "known"))).otherwise(F.col("between"))
    woven = F.flatten(F.zip_with(between, F.array_append(new, F.lit("")), lambda p, s: F.array(p, s)))
    within = some.join(of_doc, "doc").select(
        F.array_join(woven, "").alias("text"), "rest", F.size("found").cast("long").alias("n_entities"), "kinds"
    )
    columns = [F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in names]
    return without.unionByName(within).select(*columns, *sorted(added, reverse=True))
