"""Format-preserving pseudonyms of personal data, in SQL expressions only.

A found value is validated and then permuted within its format by a keyed
Feistel network, so equal values get equal pseudonyms in all documents,
different values get different ones, and the pseudonym still is a valid value:
card numbers keep their check digit, IBANs their check pair, dates stay dates.
Values that don't pass their validation are left alone, and so are numbers that
could be anything, like ten digits without a mark of a phone number.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import forgetful_parser

#: Key of the permutation; keep it secret in production.
KEY = os.environ.get("TIDEMILL_PII_KEY", "example key")
ROUNDS = 8
#: Steps by which a date before which the day stands may be moved on; all of them miss with a probability of 1e-10.
WALK = 24

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Countries by the length of their IBAN.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Country codes by the numbers of digits that may follow them, where the plan of the country fixes these within one; others have up to 15 digits in all.
PHONE_LENGTHS = {(7,): "354", (8,): "45 47 53 65 216 386 852 853", (9, 8): "32 36 51 66 213 359 385 886 971 972", (9,): "27 31 33 34 40 41 48 56 61 93 94 212 351 380 420 421 966", (10, 9): "44 81 84 92", (10,): "1 7 30 52 58 90 91 98", (11, 10): "54 55 86"}


def _iban() -> str:
    # other countries' lengths aren't known; they stop before what starts like an IBAN
    known = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    fixed = [f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, codes in IBAN_LENGTHS.items()]
    other = f"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:(?! (?:{known})[0-9]{{2}}) ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    return f"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*fixed, other])})(?![0-9A-Za-z])"


def _phone() -> str:
    mark = r"(?:[ .\-]|[ .\-]?\(|\)[ .\-]?)"  # a single digit stands only at the start
    plans = [rf"(?:{codes.replace(' ', '|')})(?:[ .\-]?\(0\))?{mark}?[0-9](?:(?:{mark}(?=[0-9]{{2}}))?[0-9]){{{n - 1}}}(?![0-9])" for lengths, codes in PHONE_LENGTHS.items() for n in lengths]
    # not after 16 digits: shorter ends are tried then
    other = r"[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}" + rf"(?<!{r'[0-9][ .()\-]{0,3}' * 15}[0-9])"
    return rf"(?<![0-9+])(?:\+(?:{'|'.join([*plans, other])})|\([0-9]{{3}}\) ?[0-9]{{3}}[ \-][0-9]{{4}}|[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}})(?![0-9])"


#: What each kind looks like, tried in this order at every place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9\-]{1,63}\.){1,6}[A-Za-z]{2,24}(?![A-Za-z0-9\-])",
    "token": r"(?<![0-9A-Za-z_\-])(?:A(?:KI|SI)A[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,76}|github_pat_[0-9A-Za-z_]{22,100}|glpat-[0-9A-Za-z_\-]{20,40}|xox[abeprs]-[0-9A-Za-z\-]{10,120}|sk-(?:[a-z]{2,8}-)?[0-9A-Za-z_\-]{20,160}|[rs]k_(?:live|test)_[0-9A-Za-z]{16,64}|AIza[0-9A-Za-z_\-]{35}|eyJ[0-9A-Za-z_\-]{8,2000}\.[0-9A-Za-z_\-]{8,2000}\.[0-9A-Za-z_\-]{8,1000})(?![0-9A-Za-z_])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "iban": _iban(),
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{2,4}:(?:[0-9A-Fa-f]{1,4}:){0,5}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ipv4": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/\-]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9])(?:(?:[0-9]{4}[ \-]){3}[0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}|[0-9]{13,19})(?![0-9])",
    "phone": _phone(),
}
_ANY = "|".join(PATTERNS.values())
#: Every kind has one of these; texts without need no closer look.
_GATE = "[0-9@]"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _permuted(value: str, alphabet: str, tag: str, key: str) -> str:
    """SQL for a keyed permutation of the strings of one length over ``alphabet``; ``tag`` is SQL as well.

    The string is halved; in turn each half gets, symbol by symbol, a keyed
    hash of the other half added modulo the alphabet's size.
    """
    r, a = len(alphabet), _sql(alphabet)

    def added(x: str, other: str) -> str:
        digest = f"sha2(concat_ws('|', {_sql(key)}, {tag}, cast(i as string), cast(length({x}) as string), {other}), 512)"
        place = f"instr({a}, substr({x}, j, 1)) - 1 + cast(conv(substr({digest}, pmod(2 * j - 2, 128) + 1, 2), 16, 10) as int)"
        return f"if({x} = '', '', array_join(transform(sequence(1, length({x})), j -> substr({a}, cast(pmod({place}, {r}) as int) + 1, 1)), ''))"

    state = lambda left, right: f"named_struct('l', {left}, 'r', {right})"
    half = f"cast(floor(length({value}) / 2) as int)"
    start = state(f"substr({value}, 1, {half})", f"substr({value}, {half} + 1)")
    step = f"if(i % 2 = 0, {state('s.l', added('s.r', 's.l'))}, {state(added('s.l', 's.r'), 's.r')})"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> {step}, s -> concat(s.l, s.r))"


def _number(value: str, low: int, a: int, b: int, tag: str, key: str) -> str:
    """SQL for a keyed permutation of the whole numbers from ``low``, of which there are a times b: a Feistel network on quotient and remainder."""

    def digest(x: str, m: int) -> str:
        return f"pmod(cast(conv(substr(sha2(concat_ws('|', {_sql(key)}, {_sql(tag)}, cast(i as string), cast({x} as string)), 256), 1, 15), 16, 10) as bigint), {m}L)"

    state = lambda q, r: f"named_struct('q', {q}, 'r', {r})"
    start = state(f"cast(floor(({value} - {low}) / {b}) as bigint)", f"cast(pmod({value} - {low}, {b}) as bigint)")
    step = f"if(i % 2 = 0, {state('s.q', f'pmod(s.r + {digest('s.q', b)}, {b}L)')}, {state(f'pmod(s.q + {digest('s.r', a)}, {a}L)', 's.r')})"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> {step}, s -> s.q * {b}L + s.r + {low})"


def _only(value: str, symbols: str) -> str:
    return f"regexp_replace({value}, '[^{symbols}]', '')"


def _put_back(value: str, symbols: str, replaced: str) -> str:
    """SQL that puts the symbols of ``replaced`` where ``value`` has symbols of the class, in order."""
    at = f"length(regexp_replace(substr({value}, 1, k), '[^{symbols}]', ''))"
    one = f"if(substr({value}, k, 1) rlike '[{symbols}]', substr(w, {at}, 1), substr({value}, k, 1))"
    # the array of one element computes the replacement once, not once a symbol
    return f"transform(array({replaced}), w -> array_join(transform(sequence(1, length({value})), k -> {one}), ''))[0]"


#: Classes of symbols that are permuted each among themselves.
_ALNUM = (("0-9", _DIGITS), ("a-z", _LOWER), ("A-Z", _UPPER))
_HEX = (("0-9", _DIGITS), ("a-f", "abcdef"), ("A-F", "ABCDEF"))


def _by_class(value: str, classes, tag: str, key: str) -> str:
    """SQL that permutes the symbols of each class where they stand, keyed by all that the other classes have there."""
    for symbols, alphabet in classes:
        seen = f"concat('{tag} {symbols} ', regexp_replace(x, '[{symbols}]', '#'))"
        value = f"transform(array({value}), x -> {_put_back('x', symbols, _permuted(_only('x', symbols), alphabet, seen, key))})[0]"
    return value


def _luhn_sum(digits: str, start: int) -> str:
    """SQL for the Luhn sum; ``start`` is 0 if the last digit counts once, 1 if twice."""
    d = f"cast(substr(reverse({digits}), p, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (t, p) -> t + if((p + {start}) % 2 = 1, {d}, {d} * 2 - if({d} > 4, 9, 0)))"


def _mod97(text: str) -> str:
    """SQL for an alphanumeric string modulo 97, letters counting 10 to 35."""
    c = f"substr({text}, p, 1)"
    digit = f"if({c} rlike '[0-9]', cast({c} as int), ascii({c}) - 55)"
    return f"aggregate(sequence(1, length({text})), 0, (t, p) -> cast(pmod(t * if({c} rlike '[0-9]', 10, 100) + {digit}, 97) as int))"


def _pseudonym(v: str, key: str) -> str:
    """SQL for struct(kind, new): what a matched value is and stands replaced by; kind is null if it isn't valid."""
    cases = []

    def case(kind: str, valid: str, new: str) -> None:
        cases.append(f"when {v} rlike {_sql('^(?:' + PATTERNS[kind] + ')$')} and ({valid}) then named_struct('kind', '{kind}', 'new', {new})")

    name, host = f"substring_index({v}, '@', 1)", f"substring_index({v}, '@', -1)"
    case("email", "true", f"concat({_by_class(name, _ALNUM, 'email', key)}, '@', {host})")
    # what such keys begin with says what they are, and stays
    start = f"regexp_extract({v}, '^(?:A(?:KI|SI)A|AIza|eyJ|[A-Za-z]+(?:_live_|_test_|_pat_|[_-]))', 0)"
    case("token", "true", f"concat({start}, {_by_class(f'substr({v}, length({start}) + 1)', _ALNUM, 'token', key)})")
    case("secret", f"{v} rlike '[0-9]' and {v} rlike '[A-Fa-f]'",
         f"if({v} = lower({v}), {_permuted(v, '0123456789abcdef', _sql('secret'), key)}, {_permuted(v, '0123456789ABCDEF', _sql('secret'), key)})")
    plain = f"replace({v}, ' ', '')"
    account = f"substr({plain}, 5)"
    moved = f"transform(array({_put_back(account, '0-9', _permuted(_only(account, '0-9'), _DIGITS, _sql('iban'), key))}), b -> concat(substr({plain}, 1, 2), lpad(cast(98 - {_mod97(f'concat(b, substr({plain}, 1, 2), {_sql('00')})')} as string), 2, '0'), b))[0]"
    case("iban", f"{_mod97(f'concat(substr({plain}, 5), substr({plain}, 1, 4))')} = 1 and length({plain}) between 15 and 34", _put_back(v, "A-Z0-9", moved))
    case("ipv6", "true", _by_class(v, _HEX, "ipv6", key))
    octet = lambda n: f"cast(split({v}, '[.]')[{n}] as bigint)"
    ip = _number(f"({octet(0)} * 16777216 + {octet(1)} * 65536 + {octet(2)} * 256 + {octet(3)})", 0, 65536, 65536, "ipv4", key)
    case("ipv4", "true", f"transform(array({ip}), n -> concat_ws('.', cast(n div 16777216 as string), cast(n div 65536 % 256 as string), cast(n div 256 % 256 as string), cast(n % 256 as string)))[0]")
    day = f"case when {v} rlike '^[0-9]{{4}}-' then try_to_date({v}, 'yyyy-MM-dd') when {v} rlike '/' then coalesce(try_to_date({v}, 'MM/dd/yyyy'), try_to_date({v}, 'dd/MM/yyyy')) else try_to_date({v}, 'dd.MM.yyyy') end"
    # the 400 years from 1800 have 189 * 773 days
    move = lambda d: f"date_add(date'1800-01-01', cast({_number(f'datediff({d}, date{_sql('1800-01-01')})', 0, 189, 773, 'date', key)} as int))"
    # a day over 12 before the month stays one, or it would be read as a month: moved on until it is
    late = f"aggregate(sequence(1, {WALK}), {day}, (d, k) -> if(k > 1 and day(d) > 12, d, {move('d')}))"
    first = f"{v} rlike '/' and cast(substr({v}, 1, 2) as int) > 12"
    case("date", f"({day}) between date'1800-01-01' and date'2199-12-31'",
         f"if({first}, date_format({late}, 'dd/MM/yyyy'), transform(array({move(f'({day})')}), n -> case when {v} rlike '^[0-9]{{4}}-' then date_format(n, 'yyyy-MM-dd') when {v} rlike '/' then date_format(n, 'MM/dd/yyyy') else date_format(n, 'dd.MM.yyyy') end)[0])")
    area, rest = f"cast(substr({v}, 1, 3) as bigint)", f"(cast(substr({v}, 5, 2) as bigint) - 1) * 9999 + cast(substr({v}, 8, 4) as bigint) - 1"
    # areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999
    whole = f"(({area} - if({area} > 666, 2, 1)) * 989901 + {rest})"
    ssn = _number(whole, 0, 898, 989901, "ssn", key)
    case("ssn", f"{area} between 1 and 899 and {area} <> 666 and substr({v}, 5, 2) <> '00' and substr({v}, 8, 4) <> '0000'",
         f"transform(array({ssn}), n -> concat(lpad(cast(n div 989901 + if(n div 989901 >= 665, 2, 1) as string), 3, '0'), '-', lpad(cast(n % 989901 div 9999 + 1 as string), 2, '0'), '-', lpad(cast(n % 989901 % 9999 + 1 as string), 4, '0')))[0]")
    digits = _only(v, "0-9")
    payload = f"substr({digits}, 1, length({digits}) - 1)"
    moved = f"transform(array({_permuted(payload, _DIGITS, _sql('card'), key)}), b -> concat(b, cast(pmod(10 - {_luhn_sum('b', 1)} % 10, 10) as string)))[0]"
    case("card", f"{_luhn_sum(digits, 0)} % 10 = 0", _put_back(v, "0-9", moved))
    # the country's digits stay: all before the first mark after a plus
    country = f"if({v} rlike '^[+]', regexp_extract({v}, '^[+][0-9]{{1,3}}', 0), '')"
    national = f"substr({v}, length({country}) + 1)"
    case("phone", f"length({digits}) between 8 and 15", f"concat({country}, {_put_back(national, '0-9', _permuted(_only(national, '0-9'), _DIGITS, _sql('phone'), key))})")
    return f"case {' '.join(cases)} else named_struct('kind', cast(null as string), 'new', {v}) end"


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with every valid value of a kind in PATTERNS replaced in the column ``text``, and the array ``pii_kinds`` of the kinds replaced, in text order.

    All other columns stay as they are; a null text stays null, with an empty
    array. Texts without values are unchanged; texts of any length are searched
    whole. A value's pseudonym depends on nothing but the value and the key.
    Repeated rows stay, with equal results; an empty table gives an empty
    result. A column of ``docs`` named pii_kinds is replaced.
    """
    work = "_found"
    while work in docs.columns:
        work += "_"
    found = f"if(text rlike '{_GATE}', transform(regexp_extract_all(text, {_sql(_ANY)}, 0), v -> {_pseudonym('v', key)}), cast(array() as array<struct<kind:string,new:string>>))"
    with forgetful_parser(docs.sparkSession):  # texts are parsed where a frame takes them
        marked = docs.withColumn(work, F.expr(found))
    between = f"split(text, {_sql(_ANY)}, -1)"
    woven = f"if(size({work}) > 0, transform(array({between}), p -> array_join(transform(p, (x, k) -> concat(x, coalesce(get({work}, k).new, ''))), ''))[0], text)"
    kinds = f"coalesce(transform(filter({work}, f -> f.kind is not null), f -> f.kind), cast(array() as array<string>))"
    return marked.withColumn("text", F.expr(woven)).withColumn("pii_kinds", F.expr(kinds)).drop(work)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the pseudonymised text, how many values of each kind were replaced, and the kinds in order."""
    out = pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(pii_kinds, k -> k = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in PATTERNS]
    return out.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_found"), *counts, F.array_join("pii_kinds", ",").alias("kinds"))
