"""Surrogates for personal data, in DataFrame and SQL functions only.

Entities are found by one pattern: e-mail, IPv4 and IPv6 addresses, phone, card and account numbers (IBAN),
social security numbers, access keys, secrets after words such as password or token, and titled personal
names.  In a document that names a person behind a title, the words of that name are replaced wherever they
stand with a capital, and so is a word with a capital that stands before such a family name within a sentence.

Each distinct entity gets a replacement drawn from a keyed digest of its canonical form, so every mention in
every document changes alike.  A replacement keeps the type and the look: letters stay letters of their case
and script, digits stay digits, punctuation, country codes, key prefixes, top-level domains and check digits'
rules stay.  Names are put together from syllables of their script, a given name with an ending of the title's
gender; titles, particles (van, de) and initials stay.  Scripts with syllables of their own are those in
CONSONANTS; names in other scripts get Latin ones.

Collision check: over all distinct entities, two must not share a replacement and none may become another
entity that occurs; those that would are drawn anew with a higher attempt number until none is left.  Names
get one syllable more with each attempt; from LAST_IN_SHAPE on other kinds get letters behind them, so that
even a kind whose values nearly all occur settles.  Replacements need no join: attempt 0 is computed in
place, and only documents that hold a redrawn entity meet the (small) table of redrawn ones.

Not found: names in no document behind a title, words without a capital, street addresses, and whatever
has another form than the patterns below.

Defined results: a null text stays null with 0 entities, an empty one empty; rows with equal or null ids
each give a row; very long texts are read whole (repeated groups of the patterns never backtrack); other
columns are kept, whatever their names; an empty table gives no rows; a null or empty key is an error.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, may_contain, with_flag, written

#: Titles by gender; other titles take the neutral list.
TITLES = {
    "male": ["Mr", "Herr", "Monsieur", "Señor", "Signor", "Sir", "господин", "Господин", "κύριος", "Κύριος"],
    "female": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Signora", "Lady", "госпожа", "Госпожа", "κυρία", "Κυρία"],
    "neutral": ["Dr", "Prof"],
}
#: Beginnings of syllables, and their vowels, by script.
CONSONANTS = {
    "latin": "b d f g h j k l m n p r s t v br dr gr kl st tr",
    "cyrillic": "б в г д ж з к л м н п р с т бр др гр ст тр",
    "greek": "β γ δ κ λ μ ν π ρ σ τ φ χ δρ κρ στ",
    "hebrew": "ב ג ד ה ז ח ט כ ל מ נ ס פ ק ר ש ת",
    "arabic": "ب ت ج د ر ز س ش ع ف ق ك ل م ن ه",
    "devanagari": "क ग च ज त द न प ब म य र ल व स ह",
    "han": "安 博 晨 德 峰 刚 国 海 华 佳 建 静 军 丽 林 龙 明 宁 平 青 荣 山 书 涛 文 晓 新 阳 永 云 志 子",
    "hangul": "가 나 다 라 마 바 사 아 자 하 기 니 미 시 지 희 구 주 수 우 도 호 소 진 민 영 현 성",
    "kana": "カ キ ク サ シ タ ナ ニ ハ マ ミ モ ヤ ユ ラ リ ア イ エ オ",
}
VOWELS = {
    "latin": "a e i o u", "cyrillic": "а е и о у", "greek": "α ε η ι ο", "hebrew": "א ו י", "arabic": "ا و ي",
    "devanagari": "ा ि ी ु े ो", "han": "", "hangul": "", "kana": "",
}
#: What family and given names end with, by script.
ENDINGS = {
    "latin": ("berg dale field ford ini ley mann sen son ton well wick", "an ard in o on us", "a ella ia ina ine ette", "e is y"),
    "cyrillic": ("енко юк ко их", "ан ей ил слав", "а ия на слава", "я"),
    "greek": ("άκης ίδης άτος έας", "ος ης ας", "α η ία", "ι"),
    "hebrew": ("בי מן ני ון", "אל ון", "ה ית", "י"),
    "arabic": ("ي اني اوي", "ان يد", "ة اء", "ي"),
    "devanagari": ("कर वाल शर", "न राज", "ती का", "ल"),
    "han": ("", "", "", ""), "hangul": ("", "", "", ""), "kana": ("", "", "", ""),
}
#: Letters that stand for letters where a string keeps its shape.
ALPHABETS = {
    "latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшыэюя", "greek": "αβγδεζηθικλμνξοπρτυφχψω",
    "hebrew": "אבגדהוזחטיכלמנסעפצקרשת", "arabic": "ابتجدرزسشعفقكلمنهوي", "devanagari": "कगचजतदनपबमयरलवसह",
} | {s: CONSONANTS[s].replace(" ", "") for s in ("han", "hangul", "kana")}
SCRIPTS = {"cyrillic": "IsCyrillic", "greek": "IsGreek", "hebrew": "IsHebrew", "arabic": "IsArabic", "devanagari": "IsDevanagari", "han": "IsHan", "hangul": "IsHangul", "kana": "IsKatakana"}
PARTICLES = "van von de del della der den di da du la le el al bin ibn ter zu zur"

_LETTER = r"[\p{L}\p{M}]"
_CASED = rf"\p{{Lu}}(?:{_LETTER}|['’](?=\p{{L}})(?!s(?!{_LETTER}))|-(?=\p{{L}}))*+"
_NAME = rf"(?:{_CASED}|\p{{IsHan}}{{1,3}}+|[\p{{Lo}}&&[^\p{{IsHan}}]][\p{{Lo}}\p{{M}}&&[^\p{{IsHan}}]]{{0,20}}+)"
_PARTICLE = rf"(?:(?:{PARTICLES.replace(' ', '|')}) ){{0,3}}+"
_TITLE = "(?:" + "|".join([*(t + r"\.?" for ts in TITLES.values() for t in ts), r"(?:MR|MRS|HERR|FRAU|MISS)\.?", *(t.upper() + r"\." for ts in TITLES.values() for t in ts if t.isascii())]) + ")"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}]|-(?=[\p{L}\p{N}-]))*+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Kind -> pattern, tried in this order.
PATTERNS = {
    "email": rf"(?<![\p{{L}}\p{{M}}\p{{N}}_.%+-])[\p{{L}}\p{{M}}\p{{N}}_.%+-]++@(?:{_LABEL}(?:\.{_LABEL})++(?<=\.[\p{{L}}\p{{M}}]{{2,24}})|(?:{_LABEL}\.){{1,10}}\p{{L}}{{2,24}}(?!{_LETTER}|\p{{N}}))",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[^\s\"',;]{6,}+",
    "key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\b(?:ghp|gho|sk|pk|xox[bp])[_-][A-Za-z0-9_-]{16,}+",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)",
    "ipv6": rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|::(?:{_HEX}:){{0,6}}{_HEX})(?![\w:])",
    "iban": r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![\w-])",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
    "phone": r"(?<![\w(+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<![\w+])\+\d{8,14}(?!\w)"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]\(?\d{1,4}\)?){3,6}(?![\w-])|(?<![\w.,+-])0\d(?:[ .-]\d{2}){4}(?![\w-])|(?<![\w.,+-])[2-9]\d{2}[2-9]\d{6}(?![\w-]|[.,]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "name": rf"(?<!{_LETTER}){_TITLE} {_PARTICLE}{_NAME}(?: (?!{_TITLE} )(?:\p{{Lu}}\. )?{_PARTICLE}{_NAME}){{0,2}}+",
}
#: None begins behind a letter or digit, which is asked once for all: most places of a text end there.
_BEGIN = r"(?<![\p{L}\p{N}_])"
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
ANY = f"{_BEGIN}(?:{_ANY})"
#: Words that may mention a person named in the document: several within a sentence, or one anywhere.
MENTION = rf"(?<=[\p{{Ll}}\p{{N}},;:)] )(?<!{_LETTER}){_CASED}(?: {_CASED}){{1,2}}+|(?<!{_LETTER})(?:{_CASED}|[\p{{Lo}}&&[^\p{{IsHan}}]][\p{{Lo}}\p{{M}}&&[^\p{{IsHan}}]]*+)"
ANY_OR_MENTION = f"{_BEGIN}(?:{_ANY}|(?:{MENTION}))"
KEPT = {
    "secret": r"^(?i:[a-z_-]+)[\"']?\s*[=:]\s*[\"']?",
    "key": r"^(?:AKIA|ASIA|[a-z]+[_-])",
    "ip": r"^(?:10\.|192\.168\.|172\.)?",
    "phone": r"^\+\d{1,3}(?=[ .(-])",
}
#: From this attempt on, letters are appended: the look gives way to distinctness.
LAST_IN_SHAPE = 6
MAX_ROUNDS = 60


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(words: str) -> str:
    return f"array({', '.join(_text(w) for w in words.split(' '))})"


def _map(of: dict[str, str]) -> str:
    """SQL: a map of text keys to SQL values."""
    return f"map({', '.join(f'{_text(k)}, {v}' for k, v in of.items())})"


def _byte(d: str, i: str) -> str:
    return f"cast(conv(substr({d}, 2 * (({i} - 1) % 64) + 1, 2), 16, 10) as int)"


def _script(s: str) -> str:
    return "case " + " ".join(f"when {s} rlike {_text(f'\\p{{{p}}}')} then '{k}'" for k, p in SCRIPTS.items()) + " else 'latin' end"


def _with(name: str, fields: dict[str, str], body: str) -> str:
    """SQL: body, in which name.field stands for the fields; each is worked out once, not at every place it stands."""
    struct = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return f"get(transform(array(named_struct({struct})), {name} -> {body}), 0)"


def _shape(s: str, d: str) -> str:
    """SQL: s with each letter or digit drawn anew from the digest; letters of a hexadecimal string stay a to f."""
    alphabet = f"element_at({_map({k: _text(v) for k, v in ALPHABETS.items()})}, {_script('c')})"
    other = f"substr({alphabet}, {_byte(d, '(i + 1)')} % length({alphabet}) + 1, 1)"
    drawn = (
        f"concat_ws('', transform(split(q.s, ''), (c, i) -> case "
        f"when c between '0' and '9' then cast({_byte(d, '(i + 1)')} % 10 as string) "
        f"when c between 'a' and 'z' then char(97 + {_byte(d, '(i + 1)')} % q.letters) "
        f"when c between 'A' and 'Z' then char(65 + {_byte(d, '(i + 1)')} % 26) "
        f"when c rlike '\\\\p{{L}}' then if(c = upper(c), upper({other}), {other}) "
        f"when c rlike '\\\\p{{N}}' then cast({_byte(d, '(i + 1)')} % 10 as string) else c end))"
    )
    return _with("q", {"s": s, "letters": f"if({s} rlike '^[0-9a-f:]+$', 6, 26)"}, drawn)


def _luhn(s: str) -> str:
    """SQL: the sum of the card check over a string of digits, from the right."""
    double = "(x.d * 2 - if(x.d > 4, 9, 0))"
    return (
        f"aggregate(transform(sequence(1, length({s})), i -> named_struct('d', cast(substr({s}, length({s}) + 1 - i, 1) as int), 'i', i)), "
        f"0, (a, x) -> a + if(x.i % 2 = 0, {double}, x.d))"
    )


def _mod97(s: str) -> str:
    """SQL: the rest of an account number in letters and digits, by the rule of its check digits."""
    return f"aggregate(split(concat(substr({s}, 5), substr({s}, 1, 4)), ''), 0, (a, c) -> if(c between '0' and '9', (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97))"


def kind_of(e: str) -> str:
    return "case " + " ".join(f"when {e} rlike {_text('^(?:' + p + ')$')} then '{k}'" for k, p in PATTERNS.items()) + f" when {e} rlike {_text('(?i:^(?:password|passwd|pwd|secret|token|api|access))')} then 'secret' else 'mention' end"


def _digits(e: str) -> str:
    return f"regexp_replace({e}, '[^0-9]', '')"


def _plain(e: str) -> str:
    return f"replace({e}, ' ', '')"


def _word_unit(kind: str, w: str) -> str:
    return f"concat({kind}, '-', {_script(w)}, '|', lower({w}))"


def units(e: str, kind: str) -> str:
    """SQL: the independent parts of an entity as 'kind|canonical' strings; the same person, number or host has
    the same parts however it is written.  Names have one for each of their words, '' for words that stay."""
    words = f"split({e}, ' ')"
    title = f"lower(replace(substring_index({e}, ' ', 1), '.', ''))"
    gender = "case " + " ".join(f"when {title} in ({', '.join(_text(t.lower()) for t in ts)}) then '{g}'" for g, ts in TITLES.items()) + " else 'neutral' end"
    name = (
        f"transform({words}, (w, i) -> case when i = 0 or w rlike {_text(r'^\p{Lu}\.$')} or not w rlike {_text(r'^[\p{Lu}\p{Lo}]')} then '' "
        f"when i = size({words}) - 1 then {_word_unit(_text('family'), 'w')} else {_word_unit(f'concat({_text("given-")}, {gender})', 'w')} end)"
    )
    core = f"if({kind} = 'secret', regexp_replace({e}, {_text(KEPT['secret'])}, ''), regexp_replace({e}, {_text(KEPT['key'])}, ''))"
    number = _digits(f"regexp_replace({e}, {_text(KEPT['phone'])}, '')")
    return (
        f"case when {kind} = 'email' then array(concat('domain|', lower(substring_index({e}, '@', -1))), concat('email|', lower({e}))) "
        f"when {kind} = 'name' then {name} "
        f"when {kind} = 'phone' then array(concat('phone|', right(regexp_replace({number}, '^0', ''), 10))) "
        f"when {kind} = 'card' then array(concat('card|', {_digits(e)})) "
        f"when {kind} = 'iban' then if({_mod97(_plain(e))} = 1, array(concat('iban|', {_plain(e)})), array('')) "
        f"when {kind} in ('secret', 'key') then array(concat({kind}, '|', {core})) "
        f"when {kind} = 'ipv6' then array(concat('ipv6|', lower({e}))) "
        f"when {kind} = 'mention' then array('') "
        f"else array(concat({kind}, '|', {e})) end"
    )


def _name_unit() -> str:
    """SQL: a name for the unit v."""
    endings = _map({f"{k}-{s}": _list(e[i]) for s, e in ENDINGS.items() for i, k in enumerate(("family", "given-male", "given-female", "given-neutral"))})

    def pick(lists: str, i: str) -> str:
        return f"element_at({lists}, {_byte('v.d', i)} % size({lists}) + 1)"

    script = "substring_index(v.kind, '-', -1)"
    begin = pick(f"element_at({_map({k: _list(x) for k, x in CONSONANTS.items()})}, {script})", "(2 * k)")
    vowel = pick(f"element_at({_map({k: _list(x) for k, x in VOWELS.items()})}, {script})", "(2 * k + 1)")
    return f"initcap(concat(concat_ws('', transform(sequence(1, 2 + v.attempt), k -> concat({begin}, {vowel}))), {pick(f'element_at({endings}, v.kind)', '1')}))"


def unit_surrogate(u: str, key: str, attempt: str) -> str:
    """SQL: the replacement of a unit."""
    fields = {
        "d": f"sha2(concat({key}, '|', {u}, '|', cast({attempt} as string)), 512)",
        "canon": f"substr({u}, instr({u}, '|') + 1)", "kind": f"substring_index({u}, '|', 1)", "attempt": attempt,
    }
    d, canon = "v.d", "v.canon"
    more = f"if(v.attempt > {LAST_IN_SHAPE}, translate(substr(v.d, 100, v.attempt - {LAST_IN_SHAPE}), '0123456789', 'ghijklmnop'), '')"
    label = f"substr({canon}, 1, length({canon}) - length(substring_index({canon}, '.', -1)) - 1)"
    octets = ", '.', ".join(f"cast(1 + {_byte(d, str(i))} % 254 as string)" for i in range(1, 5))
    private = f"regexp_extract({canon}, {_text(KEPT['ip'])}, 0)"
    dots = "length(regexp_replace({}, '[^.]', ''))"
    ip = f"concat({private}, substring_index(concat({octets}), '.', {dots.format(canon)} - {dots.format(private)} + 1))"
    drawn = _shape(canon, d)
    zero = "concat(substr(w.card, 1, length(w.card) - 1), '0')"
    card = _with("w", {"card": f"concat(substr({canon}, 1, 1), substr({drawn}, 2))"}, f"if({_luhn(canon)} % 10 = 0, concat(substr(w.card, 1, length(w.card) - 1), cast((10 - {_luhn(zero)} % 10) % 10 as string)), w.card)")
    land = f"substr({canon}, 1, 2)"
    iban = _with("w", {"rest": f"substr({drawn}, 5)"}, f"concat({land}, lpad(cast(98 - {_mod97(f'concat({land}, {_text("00")}, w.rest)')} as string), 2, '0'), w.rest)")
    body = (
        f"case v.kind when 'domain' then concat({_shape(label, d)}, {more}, '.', substring_index({canon}, '.', -1)) "
        f"when 'email' then concat({_shape(f"substring_index({canon}, '@', 1)", d)}, {more}) "
        f"when 'ip' then concat({ip}, {more}) when 'card' then concat({card}, {more}) when 'iban' then concat({iban}, {more}) "
        f"when 'phone' then concat({drawn}, {more}) when 'ssn' then concat({drawn}, {more}) when 'ipv6' then concat({drawn}, {more}) "
        f"when 'secret' then concat({drawn}, {more}) when 'key' then concat({drawn}, {more}) "
        f"else {_name_unit()} end"
    )
    return _with("v", fields, body)


def _refill(e: str, s: str, kept: str) -> str:
    """SQL: the last letters and digits of e (characters in `kept`) replaced by those of s; what s has more goes behind."""
    core = f"regexp_extract({s}, {_text(f'^{kept}*')}, 0)"
    c, upto = f"substr({e}, i, 1)", f"length(regexp_replace(substr({e}, 1, i), {_text(f'[^{kept[1:-1]}]')}, ''))"
    spare = f"(length(regexp_replace({e}, {_text(f'[^{kept[1:-1]}]')}, '')) - length({core}))"
    return (
        f"concat(concat_ws('', transform(sequence(1, length({e})), i -> if({c} rlike {_text(kept)} and {upto} > {spare}, substr({core}, {upto} - {spare}, 1), {c}))), "
        f"substr({s}, length({core}) + 1))"
    )


def _replaced(z: str) -> str:
    """SQL: the replacement text of an entity z = (e, kind, s: its units' replacements)."""
    e, kind, s = f"{z}.e", f"{z}.kind", f"{z}.s"
    email = f"concat({s}[1], '@', {s}[0])"
    prefix = f"if({kind} = 'secret', regexp_extract({e}, {_text(KEPT['secret'])}, 0), regexp_extract({e}, {_text(KEPT['key'])}, 0))"
    words = f"array_join(zip_with(split({e}, ' '), {s}, (w, r) -> case when r = '' then w when w = upper(w) and length(w) > 1 then upper(r) else r end), ' ')"
    return (
        f"case when not exists({s}, r -> r <> '') then {e} "
        f"when {kind} = 'email' then if({e} = upper({e}), upper({email}), {email}) "
        f"when {kind} in ('name', 'mention') then {words} "
        f"when {kind} in ('phone', 'card') then {_refill(e, f'{s}[0]', '[0-9]')} "
        f"when {kind} = 'iban' then {_refill(e, f'{s}[0]', '[A-Z0-9]')} "
        f"when {kind} in ('secret', 'key') then concat({prefix}, {s}[0]) else {s}[0] end"
    )


def entities(text: str, pattern: str = ANY) -> str:
    """SQL: the entities of a text, left to right, with kind and units."""
    found = f"transform(regexp_extract_all({text}, {_text(pattern)}, 0), e -> named_struct('e', e, 'kind', {kind_of('e')}))"
    return f"transform({found}, x -> named_struct('e', x.e, 'kind', x.kind, 'units', {units('x.e', 'x.kind')}))"


def mentioned(found: str, known: str) -> str:
    """SQL: entities found with ANY_OR_MENTION, where words of `known` names (units of the document) have their units."""
    unit = f"get(filter({known}, k -> substr(k, instr(k, '|') + 1) = lower(w)), 0)"
    last = f"get(filter({known}, k -> k like 'family-%' and substr(k, instr(k, '|') + 1) = lower(substring_index(x.e, ' ', -1))), 0)"
    given = _word_unit(_text("given-neutral"), "w")
    units_ = f"transform(split(x.e, ' '), w -> coalesce({unit}, if(instr(x.e, ' ') > 0 and {last} is not null, {given}, '')))"
    return f"transform({found}, x -> named_struct('e', x.e, 'kind', x.kind, 'units', if(x.kind = 'mention', {units_}, x.units)))"


def with_entities(docs: DataFrame, text_col: str, names: dict[str, str]) -> DataFrame:
    """docs with their entities, and whether the document names a person."""
    text, pii, known = f"`{text_col}`", names["pii"], names["known"]
    rows = docs.withColumn(pii, F.expr(entities(text)))
    # Family names come first, so that a word that is both is a family name.
    of_names = f"array_sort(array_distinct(flatten(transform(filter({pii}, x -> x.kind = 'name'), x -> filter(x.units, u -> u <> '')))))"
    rows = rows.withColumn(known, F.expr(of_names)).withColumn(names["named"], F.expr(f"coalesce(size({known}) > 0, false)"))
    again = mentioned(entities(text, ANY_OR_MENTION), known)
    return rows.withColumn(pii, F.expr(f"if({names['named']}, {again}, {pii})")).drop(known)


def _parts(text: Column, named: Column) -> Column:
    """What stands between the entities."""
    return F.when(named, F.split(text, ANY_OR_MENTION, -1)).otherwise(F.split(text, ANY, -1))


def redrawn_units(rows: DataFrame, key: str, pii: str) -> DataFrame | None:
    """(unit, attempt) of the units whose first replacement is not theirs alone; None if there is none."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select(F.explode(F.expr(f"filter(flatten(transform({pii}, x -> x.units)), u -> u <> '')")).alias("unit")).distinct()
    every = written(found.repartition(tasks, "unit"), "units")
    kind = F.substring_index("unit", "|", 1)
    real = every.select(kind.alias("kind"), F.expr("lower(substr(unit, instr(unit, '|') + 1))").alias("shown")).distinct()

    def drawn(units_: DataFrame) -> DataFrame:
        shown = F.lower(F.expr(unit_surrogate("unit", _text(key), "attempt")))
        shown = F.when(kind == "email", F.concat(shown, F.lit("@"), F.substring_index("unit", "@", -1))).otherwise(shown)
        return units_.select("unit", "attempt", kind.alias("kind"), shown.alias("shown"))

    now, redrawn = written(drawn(every.withColumn("attempt", F.lit(0))), "drawn"), None
    for _ in range(MAX_ROUNDS):
        # The first of a shown value, by (attempt, unit), keeps it: an aggregate, so a value that many share is
        # combined before it travels.
        owner = now.groupBy("kind", "shown").agg(F.min(F.struct("attempt", "unit")).alias("owner"), F.count("*").alias("n"))
        owner = owner.join(real.withColumn("real", F.lit(True)), ["kind", "shown"], "left").where("n > 1 or real")
        clash = now.join(owner, ["kind", "shown"]).where("real or unit <> owner.unit")
        bad = written(clash.select("unit", (F.col("attempt") + 1).alias("attempt")), "redrawn")
        if bad.isEmpty():
            return redrawn
        redrawn = bad if redrawn is None else written(redrawn.join(bad, "unit", "left_anti").unionByName(bad), "redrawn")
        now = written(now.join(bad, "unit", "left_anti").unionByName(drawn(bad)), "drawn")
    raise ValueError(f"replacements still collide after {MAX_ROUNDS} rounds")


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """docs with every entity replaced in text_col, and how many there were."""
    if not key:
        raise ValueError("surrogates need a secret key")
    names = {k: fresh(docs, f"_pii_{k}") for k in ("pii", "known", "named", "flag", "redrawn", "id", "between", "new")}
    pii = names["pii"]
    rows = with_entities(docs, text_col, names)
    redrawn = redrawn_units(rows, key, pii)
    out = [*docs.columns, count_col] if count_col not in docs.columns else docs.columns
    if redrawn is None:
        return _with_text(rows, key, None, text_col, count_col, names).select(*out)
    inside = rows.select(F.col(id_col).alias("id"), F.explode(F.expr(f"filter(flatten(transform({pii}, x -> x.units)), u -> u <> '')")).alias("unit"))
    per = inside.join(redrawn, "unit").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("unit", "attempt"))).alias(names["redrawn"]))
    per = written(per.withColumnRenamed("id", names["id"]), "redrawn-documents")
    flagged = with_flag(rows, id_col, may_contain(per, names["id"]), names["flag"])
    plain = _with_text(flagged.where(~F.col(names["flag"])), key, None, text_col, count_col, names)
    met = flagged.where(names["flag"]).join(per, F.col(id_col).eqNullSafe(F.col(names["id"])), "left")
    return plain.select(*out).unionByName(_with_text(met, key, names["redrawn"], text_col, count_col, names).select(*out))


def _with_text(rows: DataFrame, key: str, redrawn: str | None, text_col: str, count_col: str, names: dict[str, str]) -> DataFrame:
    pii, new, between = names["pii"], names["new"], names["between"]
    attempt = f"coalesce({redrawn}[u], 0)" if redrawn else "0"
    drawn = f"transform({pii}, y -> named_struct('e', y.e, 'kind', y.kind, 's', transform(y.units, u -> if(u = '', '', {unit_surrogate('u', _text(key), attempt)}))))"
    some = F.coalesce(F.size(pii), F.lit(0)) > 0
    whole = F.expr(f"concat_ws('', flatten(zip_with({between}, {new}, (a, b) -> array(a, coalesce(b, '')))))")
    count = F.expr(f"coalesce(size(filter({pii}, x -> exists(x.units, u -> u <> ''))), 0)")
    out = rows.withColumn(new, F.when(some, F.expr(f"transform({drawn}, z -> {_replaced('z')})"))).withColumn(between, F.when(some, _parts(F.col(text_col), F.col(names["named"]))))
    return out.withColumn(text_col, F.when(some, whole).otherwise(F.col(text_col))).withColumn(count_col, F.greatest(count, F.lit(0)))
