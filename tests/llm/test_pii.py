import hashlib
import random
import re

import pytest

from wavelens.llm import pii
from wavelens.llm.common import table


KEY = "a test key"


def luhn(n):
    d = [int(c) for c in n if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10


def test_formats_coreference_and_rest(spark):
    rows = [
        (1, "write to anna.55@mail4.example.com or +1 (974) 555-3436, 97.51.17.173. Card 4111 1111 1111 1111; 9807915762804490 7536784127813050"),
        (2, 'again anna.55@mail4.example.com token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" Mr John Smith, Mrs Mary Smith, Herr Иванов, 123-45-6789, DE89370400440532013000'),
        (3, None), (4, ""), (5, "nothing here 12 34 a@b"), (6, "x" * 100_000 + " b@c.de"), (7, "ANNA.55@mail4.example.com"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace(df, KEY).collect()}
    a, b = got[1].text, got[2].text
    m = re.fullmatch(r"write to ([a-z]{4}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com) or \+1 (\(\d{3}\) \d{3}-\d{4}), (\d+\.\d+\.\d+\.\d+)\. Card (\d{4} \d{4} \d{4} \d{4}); (\d{16}) (\d{16})", a)
    assert m and m[1] != "anna.55@mail4.example.com" and all(0 <= int(o) < 256 for o in m[3].split("."))
    assert luhn(m[4]) == 0 and luhn(m[5]) == luhn("9807915762804490") and m[4] != "4111 1111 1111 1111"
    assert b.startswith("again " + m[1]) and got[7].text.lower() == m[1]
    n = re.fullmatch(r'again \S+ token = "([0-9a-f]{40})" Mr (\w+) (\w+), Mrs (\w+) (\w+), Herr ([А-Я][а-я]{5}), (\d{3}-\d\d-\d{4}), (DE[0-9]{20})', b)
    assert n and n[2] in pii.MALE_NAMES and n[4] in pii.FEMALE_NAMES and n[3] == n[5] != "Smith" and n[2] != "John" and n[6] != "Иванов"
    assert got[3].text is None and got[4].text == "" and got[5].text == rows[4][1] and got[6].text.startswith("x" * 99_000)
    assert got[1].n_card == 3 and got[1].n_email == 1 and got[2].n_name == 3 and got[2].n_secret == 1 and got[3].n_email == 0
    assert pii.replace(df.limit(0), KEY).count() == 0


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = {r.doc_id: r.text for r in pii.replace(docs, KEY).select("doc_id", "text").collect()}
    rx = re.compile(r"\S+@\S+\.\S+|\b\d{16}\b|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d+\.\d+\.\d+\.\d+\b|\b[0-9a-f]{40}\b")
    pairs = {}
    for r in docs.collect():
        was, now = rx.findall(r.text or ""), rx.findall(got[r.doc_id] or "")
        assert len(was) == len(now)
        assert rx.sub("#", r.text or "") == rx.sub("#", got[r.doc_id] or "")
        for x, y in zip(was, now):
            assert pairs.setdefault(x, y) == y and x != y
    assert len(pairs) > 5 and len(set(pairs.values())) == len(pairs)


def test_short_entities_always_change_and_stay_distinct(spark):
    rows = [(i, f"Dr {a}{b} wrote to {a}{b}@x.de from 10.0.{i % 256}.1") for i, (a, b) in enumerate((a, b) for a in "BCDFGHKLMŁ" for b in "aeiouśt")]
    rows += [(900, "password: ********"), (901, "Mr Jobn, Mr Jane, Mr Li")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.collisions(df, KEY) == 0
    got = {r.doc_id: r.text for r in pii.replace(df, KEY).collect()}
    assert got[900] == rows[-2][1]
    names = [(was.split()[1], got[i].split()[1]) for i, was in rows[:-2]]
    assert all(a != b for a, b in names) and len({b for _, b in names}) == len(names)
    assert got[901].split()[1].rstrip(",") not in pii.MALE_NAMES + pii.FEMALE_NAMES


def test_secrets_in_any_case(spark, sf_dir):
    low = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
    rows = [
        (1, f'TOKEN = "{low.upper()}"'), (2, f"see {low.upper()} there"), (3, f"see {low} there"), (4, "Password: hunter2hunter2"), (5, "API_KEY=Zz9-Qk/ghXY+12=="),
        (6, "ab" * 16), (7, "A" * 32), (8, "token: " + "g" * 8), (9, "token: " + "a" * 8), (10, f"mixed {low[:20]}{low[20:].upper()}"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.collisions(df, KEY) == 0
    got = {r.doc_id: r for r in pii.replace(df, KEY).collect()}
    assert all(got[i].n_secret == 1 and got[i].text != was for i, was in rows)
    m = re.fullmatch(r'TOKEN = "([0-9A-F]{40})"', got[1].text)
    assert m and got[2].text == f"see {m[1]} there" and got[3].text == f"see {m[1].lower()} there"
    assert re.fullmatch(r"Password: [a-z]{6}\d[a-z]{6}\d", got[4].text) and re.fullmatch(r"API_KEY=[A-Z][a-z]\d-[A-Z][a-z]/[a-z]{2}[A-Z]{2}\+\d\d==", got[5].text)
    assert re.fullmatch(r"mixed (?=.*[a-f])(?=.*[A-F])[0-9a-f]{20}[0-9A-F]{20}", got[10].text)
    docs = table(spark, sf_dir.replace("sf0.001", "sf0.1"), "documents").where("doc_id IN (2514, 8743)")
    was, now = ([r.text for r in f.orderBy("doc_id").collect()] for f in (docs, pii.replace(docs, KEY)))
    found = [x for t in was for x in re.findall(r"\b[0-9A-F]{40}\b", t)]
    assert len(found) == 10 and not any(x in t for x in found for t in now)


def test_secrets_of_any_length_leave_no_tail(spark):
    rng = random.Random(4)
    hexes = ["".join(rng.choices("0123456789abcdef", k=k)) for k in (129, 200, 1000)]
    values = ["".join(rng.choices("ghijKLMN23456-/+ñд", k=k)) for k in (63, 64, 65, 128, 256, 402, 70_000)]
    values += [values[5][:300] + "h" * 102, "y" + values[5][1:], "#" * 300 + values[0]]
    values += [re.sub("[ñд]", "q", values[5]), re.sub("[ñд]", "q", values[5]).swapcase()]
    rows = list(enumerate([f"see {h} there" for h in hexes] + [f"api_key={v} there" for v in values]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.collisions(df, KEY) == 0
    got = {r.doc_id: r for r in pii.replace(df, KEY).collect()}
    assert all(got[i].n_secret == 1 and len(got[i].text) == len(was) for i, was in rows)
    now = [got[i].text.removeprefix("see ").removeprefix("api_key=").removesuffix(" there") for i, _ in rows]
    for was, new in zip(hexes + values, now):
        for at in range(0, len(was) - 15, 16):  # every part of it is replaced
            part = was[at : at + 16]
            assert new[at : at + 16] != part or part == "#" * 16
    assert all(re.fullmatch("[0-9a-f]+", x) for x in now[:3])
    long = now[3 + 5]
    assert now[3 + 7][:300] != long[:300] and now[3 + 8][1:] != long[1:]  # a shared part gets no surrogate of its own
    assert now[3 + 10] == now[3 + 11].swapcase()
    assert len(set(now)) == len(now)


def number(key, context):
    return int(hashlib.sha256((key + context.lower()).encode()).hexdigest()[:8], 16)


def shifted(c, k, alphabets):
    for a in alphabets:
        if c in a:
            return a[(a.index(c) + k) % len(a)]
    return c


def one_pass(e, key, alphabets, ahead, given, sign):
    """Every character shifted by a hash of the characters passed before it, of the input or of the output."""
    blocks = [e[c : c + pii.CHAPTER][i : i + pii.BLOCK] for c in range(0, len(e), pii.CHAPTER) for i in range(0, len(e[c : c + pii.CHAPTER]), pii.BLOCK)]
    chain, out = "", []
    for b in blocks if ahead else blocks[::-1]:
        done = ""
        for i in range(len(b)) if ahead else range(len(b) - 1, -1, -1):
            near = (b[:i] if ahead else b[i + 1 :]) if given else done
            new = shifted(b[i], sign * number(key, chain + near), alphabets)
            done = done + new if ahead else new + done
        chain = hashlib.sha256((key + chain + (b if given else done).lower()).encode()).hexdigest()
        out.append(done)
    return "".join(out if ahead else out[::-1])


def permuted(e, key, alphabets):
    s = one_pass(e, key + ">", alphabets, True, True, 1)
    t = one_pass(s, key + "<", alphabets, False, False, 1)
    u = "".join(shifted(c, 1, alphabets) for c in t)
    return one_pass(one_pass(u, key + "<", alphabets, False, True, -1), key + ">", alphabets, True, False, -1)


def surrogate(e, kind):
    key = f"{KEY}/{kind}/"
    if kind == "email":
        dot = e.rindex(".")
        return permuted(e[:dot], key, pii.ALPHABETS) + e[dot:]
    if kind == "phone":
        head = re.match(r"[+][0-9]{1,3}[ .-]|[+][0-9]|", e)[0]
        return head + permuted(e[len(head) :], key, pii.ALPHABETS[:1])
    if kind == "card":
        body = permuted(e[:-1], key, pii.ALPHABETS[:1])
        return body + str((luhn(e[:-1] + "0") - luhn(body + "0") + int(e[-1])) % 10)
    if kind == "account":
        return e[:2] + permuted(e[2:], key, pii.ALPHABETS)
    if kind == "name":
        title, *parts = e.split(" ")
        made = pii.given_names(pii.MALE_NAMES, key) | pii.given_names(pii.FEMALE_NAMES, key)
        out = []
        for w in parts:
            x = made.get(w) or permuted(w, key, pii.NAME_ALPHABETS)
            while w not in made and x in made:
                x = permuted(x, key, pii.NAME_ALPHABETS)
            out.append(x)
        return " ".join([title, *out])
    if kind == "ip":
        def walk(v, k, ahead, given, sign):
            out = []
            for i in range(4) if ahead else range(3, -1, -1):
                near = (v[:i] if ahead else v[i + 1 :]) if given else (out if ahead else out[::-1])
                out.append((v[i] + sign * number(k, ".".join(map(str, near)))) % 256)
            return out if ahead else out[::-1]

        v = walk(list(map(int, e.split("."))), key + ">", True, True, 1)
        v = [(x + 1) % 256 for x in walk(v, key + "<", False, False, 1)]
        return ".".join(map(str, walk(walk(v, key + "<", False, True, -1), key + ">", True, False, -1)))
    return permuted(e, key, pii.HEX_ALPHABETS if kind == "secret" else pii.ALPHABETS[:1])


FOUND = {
    "email": ["anna.55@mail4.example.com", "A_b%c+d-e@x.de", "x" * 90 + "@long.example"], "phone": ["+1 (974) 555-3436", "+49 170 1234567", "(212) 555-0100"], "ip": ["97.51.17.173", "0.0.0.0", "255.255.255.255"],
    "card": ["4111 1111 1111 1111", "9807915762804490", "6011-0000-0000-0004"], "account": ["DE89370400440532013000"], "ssn": ["123-45-6789"],
    "name": ["Mr John Smith", "Mrs Mary Smith", "Dr Mary", "Mr John Ronald Reuel Smith", "Herr Müller"], "secret": ["9b0b3c6a43eb78aa99cbd7049c572391524f37a8", "AB" * 16, "Zz9-Qk/ghXY+12==", "k" * 150],
}


def test_surrogates_match_brute_force(spark):
    rows = [(kind, e) for kind, found in FOUND.items() for e in found]
    df = spark.createDataFrame([(i, f"so api_key={e} so" if kind == "secret" else f"so {e} so") for i, (kind, e) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace(df, KEY).collect()}
    for i, (kind, e) in enumerate(rows):
        assert got[i][f"n_{kind}"] == 1, e
        assert got[i].text.removeprefix("so ").removeprefix("api_key=").removesuffix(" so") == surrogate(e, kind), e


def test_documents_match_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", pii.F.explode(pii.entities()).alias("e")).select("doc_id", "e", pii.F.expr(pii.kind_sql("e")).alias("kind"), pii.F.expr(pii.surrogate_sql("e", KEY)).alias("s")).collect()
    assert len(found) > 20 and all(r.s == surrogate(r.e, r.kind) for r in found)


def test_no_key_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "to a@b.de", "x", 5), (1, "to a@b.de", "x", 5)], "doc_id long, text string, _entities string, n_email int")
    with pytest.raises(ValueError):
        pii.replace(df, "")
    got = pii.replace(df, KEY).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0]._entities == "x" and got[0].n_email == 1
    assert pii.replace(df, "another").first().text != got[0].text


def test_plan_stays_small(spark):
    """The driver plans, logs and keeps every expression of it; a copy of the permutation for every kind made 70,000 characters of SQL."""
    assert len(pii.surrogate_sql("e", KEY)) < 15_000
    made = spark.createDataFrame([(1, "to a@b.de")], "doc_id long, e string").select(pii.F.expr(pii.surrogate_sql("e", KEY)).alias("s"))
    assert len(made._jdf.queryExecution().toString()) < 100_000
