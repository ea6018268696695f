"""Personal data replaced by surrogates, with DataFrame functions only.

Entities are e-mail addresses, phone numbers, IPv4 addresses, payment card numbers, account and social security numbers,
secrets, and names after a title. Each is replaced where it stands; all other text stays byte for byte.

A surrogate is a keyed, format-preserving permutation of its entity. Character i is shifted within its own alphabet
(digits, lower or upper letters of one script) by a keyed hash of the characters before it, then, in a second pass, by a
keyed hash of the shifted characters after it; every character moves one step, and both passes are undone. So within a kind
distinct entities get distinct surrogates, none is its own, and one entity gets one surrogate everywhere; hashes ignore
case, so spellings that differ in case stay related. Separators, the phone's country code, the top-level domain and a card's
distance to its check digit stay; octets stay octets. Secrets may have any length: for long ones the hashed context is a chain
of hashes of blocks, so the time stays in proportion. A known given name becomes the next of the same gender on a circle whose order
the key decides; other name parts change vowels to vowels and consonants to consonants and never become a listed name. A name is a
title and up to four capitalised words after it; mentions without a title are not found.

Whoever has the key can undo the permutation, so there is no default: keep it secret, or throw it away.

Texts are scanned once; entities and the text between them are written to the shared folder. Before use, the distinct entities of the
whole corpus are checked: if two of a kind share a surrogate, or one is its own surrogate, the key is tweaked and the check
repeated; if no key passes, that is an error. That a surrogate is by chance some other entity of the corpus is not excluded: among
millions of addresses of a small kind (IPv4) it is certain to happen, and it tells nothing, as any entity may be a surrogate. No table of entities is needed to
replace them, so texts are not shuffled and a frequent entity costs no more than a rare one.

Null texts stay null, with zero counts. Rows are independent: repeated rows give repeated results. An empty table gives an empty
result; columns named like the counts are replaced, all others kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, unique_name

KINDS = ("email", "phone", "ip", "card", "account", "ssn", "name", "secret")
#: Titles and given names by gender, in natural order.
MALE_TITLES = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Sir")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme")
NEUTRAL_TITLES = ("Dr", "Prof")
MALE_NAMES = ("Adam", "Carlos", "David", "Hans", "James", "Jean", "John", "Juan", "Karl", "Louis", "Mark", "Michael", "Paul", "Peter", "Pierre", "Robert", "Thomas", "William")
FEMALE_NAMES = ("Alice", "Anna", "Carmen", "Claire", "Elena", "Emma", "Greta", "Helen", "Jane", "Julia", "Laura", "Linda", "Maria", "Marie", "Mary", "Sarah", "Sophie", "Susan")
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
NAME_ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", *ALPHABETS[3:])
#: Disjoint, so that a shift can be undone: hexadecimal letters stay such, in their case.
HEX_ALPHABETS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", *ALPHABETS[3:])

_TITLE = "|".join(MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES)
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.)+\p{L}{2,63}",
    "phone": r"(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![\p{L}\p{N}])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
    "ip": rf"(?<![\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "account": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.?(?: \p{{Lu}}[\p{{L}}'-]++){{1,4}}",
    "secret": r"(?<=(?i:token|secret|password|passwd|api[_-]?key)[\x22']?\s{0,2}[:=]\s{0,2}[\x22']?)[^\s\x22']{8,}+|(?<![\p{L}\p{N}])[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])",
}
ENTITY = "|".join(PATTERNS.values())
#: Most rounds in which a name leaves the lists; each has a chance of about one in a thousand for short names, less for longer.
WALK = 4
#: Characters permuted at a time, and how many are gathered (whole blocks) before they join the rest.
BLOCK, CHAPTER = 64, 1 << 15
LETTER = r"[\p{L}\p{N}]"
#: No entity is in a text without one of these.
_HINT = rf"[0-9@]|(?:{_TITLE})\.? \p{{Lu}}|(?i:token|secret|password|passwd|key)|[a-fA-F]{{32}}"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(values: tuple[str, ...]) -> str:
    """SQL: a constant array of strings without commas."""
    return f"split({_sql(','.join(values))}, ',')"


def _shift(c: str, k: str, abc: str, sign: str = "+") -> str:
    """SQL: the character k places on (or back) in the one of the disjoint alphabets that has it; characters of no alphabet stay."""
    return f"aggregate({abc}, {c}, (r, g) -> if(instr(g, r) > 0, substr(g, int(pmod(instr(g, r) - 1 {sign} {k}, length(g))) + 1, 1), r))"


def _hash(key: str, context: str) -> str:
    """SQL: a keyed number below 2^32 from a context, without regard to case; the key is SQL."""
    return f"cast(conv(substr(sha2(concat({key}, lower({context})), 256), 1, 8), 16, 10) AS bigint)"


def _let(value: str, name: str, body: str) -> str:
    """SQL: the body with a name bound to a string value."""
    return f"aggregate(array({value}), '', (_z, {name}) -> {body})"


def _pass(e: str, key: str, abc: str, ahead: bool, given: bool, sign: str = "+") -> str:
    """SQL: one pass over a string, from its start or its end, with contexts from the input if given, else from the output.

    The context of a character is a hash of all blocks passed before and its own block's characters passed before, so the
    time is linear in the length. The state is an array of that hash and the output. Key and alphabets are SQL.
    """
    order, near = ("sequence(1, length(b))", "substr(b, 1, i - 1)") if ahead else ("sequence(length(b), 1, -1)", "substr(b, i + 1)")
    moved = _shift("substr(b, i, 1)", _hash(key, f"concat(x[0], {near if given else 'a'})"), abc, sign)
    block = f"aggregate({order}, '', (a, i) -> {f'concat(a, {moved})' if ahead else f'concat({moved}, a)'})"
    passed = f"sha2(concat({key}, x[0], lower({'b' if given else 'o'})), 256)"
    joined = lambda state, new: f"concat({state}, {new})" if ahead else f"concat({new}, {state})"
    cut = lambda t, n: f"{'' if ahead else 'reverse'}(regexp_extract_all({t}, '(?s).{{1,{n}}}', 0))"
    blocks = f"aggregate({cut('c', BLOCK)}, array(y[0], ''), (x, b) -> transform(array({block}), o -> array({passed}, {joined('x[1]', 'o')}))[0])"
    return f"aggregate({cut(e, CHAPTER)}, array('', ''), (y, c) -> transform(array({blocks}), z -> array(z[0], {joined('y[1]', 'z[1]')}))[0])[1]"


def _permute(e: str, key: str, abc: str, step: tuple[str, str]) -> str:
    """SQL: both passes, one step on in every alphabet, and both passes undone.

    A step moves every string that has a character of an alphabet, and so does the same step seen through a permutation.
    """
    fore, aft = f"concat({key}, '>')", f"concat({key}, '<')"
    ahead = _pass(e, fore, abc, True, True)
    back = _pass("s", aft, abc, False, False)
    unback = _pass("u", aft, abc, False, True, "-")
    unahead = _pass("v", fore, abc, True, False, "-")
    return _let(ahead, "s", _let(back, "t", _let(f"translate(t, {step[0]}, {step[1]})", "u", _let(unback, "v", unahead))))


def _luhn(digits: str) -> str:
    """SQL: the check sum of a digit string whose last digit stands next to the check digit."""
    d = f"int(substr({digits}, length({digits}) - j, 1))"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (acc, j) -> acc + CASE WHEN j % 2 = 1 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)"


def _ip(e: str, key: str) -> str:
    """SQL: the permutation over octets."""
    none = "cast(array() AS array<int>)"
    joined = lambda x: f"array_join({x}, '.')"
    parts = f"transform(split({e}, '[.]'), o -> int(o))"
    ahead = f"aggregate(sequence(1, 4), {none}, (acc, i) -> concat(acc, array(int(({parts}[i - 1] + {_hash(_sql(key + '>'), joined(f'slice({parts}, 1, i - 1)'))}) % 256))))"
    back = f"aggregate(sequence(4, 1, -1), {none}, (acc, i) -> concat(array(int((s[i - 1] + {_hash(_sql(key + '<'), joined('acc'))}) % 256)), acc))"
    step = "transform(t, x -> (x + 1) % 256)"
    unback = f"transform(sequence(1, 4), i -> int(pmod(u[i - 1] - {_hash(_sql(key + '<'), joined('slice(u, i + 1, 4 - i)'))}, 256)))"
    unahead = f"aggregate(sequence(1, 4), {none}, (acc, i) -> concat(acc, array(int(pmod(v[i - 1] - {_hash(_sql(key + '>'), joined('acc'))}, 256)))))"
    return _let(ahead, "s", _let(back, "t", _let(step, "u", _let(unback, "v", joined(unahead)))))


def given_names(names: tuple[str, ...], key: str) -> dict[str, str]:
    """What each of a list's names becomes: the next on a circle in the order of keyed hashes, so never itself."""
    order = sorted(names, key=lambda n: hashlib.sha256((key + n).encode()).digest())
    return dict(zip(order, order[1:] + order[:1]))


def kind_sql(e: str) -> str:
    """SQL: the kind of a found entity."""
    return (
        f"CASE WHEN instr({e}, '@') > 0 AND {e} RLIKE {_sql('^(?:' + PATTERNS['email'] + ')$')} THEN 'email' WHEN {e} RLIKE '^[+(]' AND {e} RLIKE '^[+(]?[0-9 ().+-]+$' THEN 'phone' WHEN {e} RLIKE '^[0-9]+([.][0-9]+){{3}}$' THEN 'ip' "
        f"WHEN {e} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'ssn' WHEN {e} RLIKE '^[0-9][0-9 -]{{11,36}}[0-9]$' AND length(regexp_replace({e}, '[^0-9]', '')) <= 19 THEN 'card' "
        f"WHEN {e} RLIKE '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}$' THEN 'account' WHEN {e} RLIKE {_sql('^(?:' + _TITLE + ')[.]? ')} THEN 'name' ELSE 'secret' END"
    )


def surrogate_sql(e: str, key: str) -> str:
    """SQL: the surrogate of a found entity. Letters of no alphabet alone give keyed letters in the entity's format.

    The permutation is written once, for all kinds: an entity's kind gives its key, its alphabets and what stays before
    and after. A copy for every kind would make a plan of many thousand expressions, which the driver plans and logs.
    """
    dot = f"(length({e}) - instr(reverse({e}), '.'))"
    kinds = f"array({_array(ALPHABETS)}, {_array(ALPHABETS[:1])}, {_array(NAME_ALPHABETS)}, {_array(HEX_ALPHABETS)})"
    head = f"CASE kind WHEN 'phone' THEN regexp_extract({e}, '^([+][0-9]{{1,3}}[ .-]|[+][0-9]|)', 1) WHEN 'account' THEN substr({e}, 1, 2) WHEN 'name' THEN concat(split({e}, ' ')[0], ' ') ELSE '' END"
    tail = f"CASE kind WHEN 'email' THEN substr({e}, {dot} + 1) WHEN 'card' THEN substr({e}, -1) ELSE '' END"
    abc = f"{kinds}[CASE kind WHEN 'secret' THEN 3 WHEN 'name' THEN 2 WHEN 'email' THEN 0 WHEN 'account' THEN 0 ELSE 1 END]"
    own = f"transform(array({kind_sql(e)}), kind -> named_struct('kind', kind, 'key', concat({_sql(key + '/')}, kind, '/'), 'head', {head}, 'tail', {tail}, 'abc', {abc}))"
    # a step is the translation from all alphabets to all of them, each turned by one
    turned = "array_join(transform(f.abc, g -> concat(substr(g, 2), substr(g, 1, 1))), '')"
    moved = _permute("x", "f.key", "f.abc", ("array_join(f.abc, '')", turned))
    made = given_names(MALE_NAMES, f"{key}/name/") | given_names(FEMALE_NAMES, f"{key}/name/")
    listed, new = _array(tuple(made)), _array(tuple(made.values()))
    # a known given name becomes another; names outside the lists stay outside: the permutation goes on until it leaves the lists
    other = f"aggregate(sequence(1, if(f.kind = 'name', {WALK}, 1)), w, (x, n) -> if(n = 1 OR array_contains({listed}, x), {moved}, x))"
    part = f"CASE WHEN f.kind = 'name' AND array_contains({listed}, w) THEN {new}[int(array_position({listed}, w)) - 1] ELSE {other} END"
    body = f"substr({e}, length(f.head) + 1, length({e}) - length(f.head) - length(f.tail))"
    parts = f"if(f.kind = 'name', split({body}, ' '), array({body}))"
    digits = lambda x: f"regexp_replace({x}, '[^0-9]', '')"
    # a card's last digit is moved by the change of the others' check sum
    end = f"if(f.kind = 'card', string(pmod(int(f.tail) + ({_luhn(digits(body))}) - ({_luhn(digits('b'))}), 10)), f.tail)"
    whole = _let(f"array_join(transform({parts}, w -> {part}), ' ')", "b", f"concat(f.head, b, {end})")
    letters = f"translate(substr(sha2(concat({_sql(key)}, {e}), 256), 1, 24), '0123456789abcdef', 'ghijklmnopqrstuv')"
    plain = f"CASE f.kind WHEN 'email' THEN concat(substr({letters}, 1, 12), '@', substr({letters}, 13), substr({e}, {dot} + 1)) WHEN 'name' THEN concat(split({e}, ' ')[0], ' ', initcap({letters})) ELSE {letters} END"
    chosen = _let(f"if(f.kind = 'ip', {_ip(e, f'{key}/ip/')}, {whole})", "_m", f"if(_m <> {e} OR NOT {e} RLIKE {_sql(LETTER)}, _m, {plain})")
    return f"transform({own}, f -> {chosen})[0]"


def entities(text: str = "text") -> F.Column:
    """The entities of a text in order; none for null."""
    t = f"coalesce(`{text}`, '')"
    return F.expr(f"if({t} RLIKE {_sql(_HINT)}, regexp_extract_all({t}, {_sql(ENTITY)}, 0), cast(array() AS array<string>))")


def collisions(df: DataFrame, key: str, text: str = "text") -> int:
    """Number of surrogates that two entities of a kind share or that equal their entity, over all rows of the frame.

    An entity without any letter or digit stays as it is and does not count.
    """
    return _collisions(df.select(entities(text).alias("e")), "e", key)


def _collisions(df: DataFrame, found: str, key: str) -> int:
    each = df.select(F.explode(found).alias("e")).groupBy("e").agg(F.lit(1).alias("one"))
    made = each.select("e", F.expr(surrogate_sql("e", key)).alias("s"))
    return made.groupBy("s").agg(F.count("*").alias("n"), F.max((F.col("e") == F.col("s")) & F.col("e").rlike(LETTER)).alias("same")).where("n > 1 OR same").count()


def replace(df: DataFrame, key: str, text: str = "text", attempts: int = 4) -> DataFrame:
    """The frame with surrogates in ``text``, and the number of entities of each kind in columns ``n_<kind>`` (replaced if there)."""
    if not key:
        raise ValueError("a key is needed: surrogates without one can be undone by anyone")
    scratch = Scratch(df.sparkSession, "pii")
    e, p, k = (unique_name(df, x) for x in ("_entities", "_parts", "_kinds"))
    some = F.size(e) > 0
    scanned = df.withColumn(e, entities(text)).withColumns({p: F.when(some, F.expr(f"split(`{text}`, {_sql(ENTITY)}, -1)")), text: F.when(~some, F.col(text))})
    scanned = scratch.save(scanned)
    for attempt in range(attempts):
        tweaked = key if not attempt else f"{key}#{attempt}"
        if not _collisions(scanned, e, tweaked):
            break
    else:
        raise ValueError(f"surrogates still collide after {attempts} keys")
    made = F.expr(f"array_join(zip_with(`{p}`, concat(transform(`{e}`, e -> {surrogate_sql('e', tweaked)}), array('')), (p, s) -> concat(p, s)), '')")
    out = scanned.withColumn(k, F.expr(f"transform(`{e}`, e -> {kind_sql('e')})")).withColumn(text, F.when(some, made).otherwise(F.col(text)))
    out = out.withColumns({f"n_{kind}": F.expr(f"bigint(size(filter(`{k}`, x -> x = '{kind}')))") for kind in KINDS})
    return out.drop(e, p, k)
