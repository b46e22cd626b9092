"""PII surrogates against a plain version: what is detected, which values come out, and the rewritten texts."""

import re
import regex

from episodica.llm import pii

TEXTS = [
    "Mr John Smith called. Smith said John Smith's left; smith no, SMITH yes, Smithson no. Johnny no.",
    "Dr. Anna Jones saw Prof Jones. Mrs O'Brien: O'Brien, D'Arcy.", "Mr Jones alone, Jones here", "Smith untitled stays",
    "IPv6 2001:0db8:85a3:0000:0000:8a2e:0370:7334 and fe80::1, 2001:DB8::7, ::ffff:1, ::ffff:1.2.3.4, at 12:30:45, face::add, 1::2::3", "GET http://[2001:db8::1]:80/",
    "IBAN DE89 3704 0044 0532 0130 00, GB29NWBK60161331926819, DE89370400440532013001", "Herr Jones and Frau Jones, Mr Anna Berg, Frau Anna Berg, Anna, Berg",
    "card 4111-1111-1111-1111 or 4111 1111 1111 1112, 378282246310005", "Господин Иван Петров и Петров. Доктор Анна Петров", "Κύριος Νίκος Παππάς, Παππάς",
    "a@b.co, A@B.co; 123-45-6789 123-45-6789", "", None, "Mr X", "Mr John Smith " * 300 + "Smith " * 2000,
]


def kind_of(value):
    return next(name for name, pattern in pii.TYPES if regex.fullmatch(pattern, value))


def script(value):
    return "cyrillic" if regex.search(r"\p{Cyrillic}", value) else "greek" if regex.search(r"\p{Greek}", value) else "latin"


def entities(text):
    """(start, end, value, type, canon) of a text, sorted."""
    out, names, free, at = [], {}, [], 0
    for m in regex.finditer(pii.ANY, text):
        free.append((at, m.start()))
        at = m.end()
        kind, value = kind_of(m[0]), m[0]
        if kind == "name":
            title, *parts = value.split(" ")
            title = title.rstrip(".")
            gender = "m" if title in pii.MALE else "f" if title in pii.FEMALE else "n"
            begin = m.start() + len(value.split(" ")[0]) + 1
            for k, part in enumerate(parts):
                t = f"family_{script(part)}" if k + 1 == len(parts) else f"given_{gender}_{script(part)}"
                out.append((begin, begin + len(part), part, t, part.lower()))
                names.setdefault(part.lower(), []).append((t.startswith("given"), begin, t))
                begin += len(part) + 1
            continue
        plain = regex.sub("[^A-Za-z0-9]", "", value)
        code = regex.match(r"\+([0-9]{1,3})[\x20.(-]", value)
        canon = {"email": value.lower(), "ip6": value.lower(), "ip": value}.get(kind, plain)
        if kind == "phone":
            canon = f"{code[1]}+{plain[len(code[1]) :]}" if code else plain
        out.append((m.start(), m.end(), value, kind, canon))
    free.append((at, len(text)))
    for a, b in free if names else ():
        for m in regex.finditer(pii.WORD, text[a:b]):
            if m[0].lower() in names:
                out.append((a + m.start(), a + m.end(), m[0], min(names[m[0].lower()])[2], m[0].lower()))
    return sorted(out)


def rendered(value, kind, new):
    upper = value == value.upper() and len(value) > 1
    if kind in ("iban", "ssn", "card", "phone"):
        letters = iter(regex.sub("[^A-Za-z0-9]", "", new))
        return "".join(next(letters) if regex.match("[A-Za-z0-9]", c) else c for c in value)
    if kind in ("email", "ip"):
        return new
    if upper:
        return new.upper()
    return new if kind == "ip6" else "-".join(x[:1].upper() + x[1:] for x in new.split("-"))


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(d, t): entities(t or "") for d, t in rows}
    own = sorted({(k, c) for x in found.values() for *_, k, c in x})
    known = {(r.type, r.canon): r.surrogate for r in pii.surrogates(spark.createDataFrame(own, "type string, canon string"), "key").collect()}
    assert set(known) == set(own) and len({(k, s) for (k, _), s in known.items()}) == len(own)
    assert not {(k, s) for (k, _), s in known.items()} & set(own)
    want = []
    for (d, t), spans in found.items():
        text = t
        for a, b, value, kind, canon in reversed(spans):
            text = text[:a] + rendered(value, kind, known[kind, canon]) + text[b:]
        want.append((d, text, len(spans), ",".join(sorted({x[3] for x in spans}))))
    got = pii.pseudonymise(docs, "key").collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r.n_entities, r.entity_types) for r in got))) == sorted(map(repr, want))
    return known


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def luhn(card):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(card))) % 10


def test_rewritten_texts_equal_a_plain_version(spark, sf):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, table)
    known = check(spark, list(enumerate(TEXTS)))
    told = {canon: kind for kind, canon in known}
    assert told["smith"] == "family_latin" and ("given_n_latin", "anna") in known and ("family_latin", "o'brien") in known
    assert {c for k, c in known if k == "ip6"} == {"2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1", "2001:db8::7", "::ffff:1", "2001:db8::1"}
    for (kind, canon), new in known.items():
        if kind == "iban":
            assert (mod97(canon) == 1) == (mod97(new) == 1) and new[:2] == canon[:2] and len(new) == len(canon)
        if kind == "card":
            assert (luhn(canon) == 0) == (luhn(new) == 0) and new[0] == canon[0] and len(new) == len(canon)
        if kind == "ip6":
            assert regex.fullmatch(pii.IP6.replace("(?=[0-9A-Fa-f:]{0,39}[0-9])", ""), new) and len(new) == len(canon)


def test_own_columns_replace_clashing_ones(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Mr John Smith", 7, "x", "y")], "doc_id long, text string, n_entities long, Entity_Types string, spans string")
    pii.pseudonymise(docs, "key").write.parquet(str(tmp_path / "out"))
    (r,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert (r.doc_id, r.n_entities, r.entity_types, r.spans) == (1, 2, "family_latin,given_m_latin", "y")


def test_a_format_that_is_used_up_ends(spark, monkeypatch):
    monkeypatch.setattr(pii, "ATTEMPTS", 2)
    own = [("ip", f"{a}.{b}") for a in range(3) for b in range(3)] + [("ssn", f"9{k:02}") for k in range(100)]
    got = pii.surrogates(spark.createDataFrame(own, "type string, canon string"), "key").collect()
    assert len({(r.type, r.surrogate) for r in got}) == len(own)
    assert all(r.surrogate.startswith("ssn-") for r in got if r.type == "ssn")


def test_letters_beyond_ascii_titles_and_digits_without_separators(spark):
    texts = ["müller@firma.de", "иван.петров@почта.рф, ΜΑΡΙΑ@x.gr", "phone 5551234567 or Tel.: 15551234567", "Mme Dupont, M. Durand et Sra. Ruiz", "the number 5551234567 and M Durand stay"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(rows, "key").collect()}
    address = re.fullmatch(r"([a-z]{6})@[a-z]+\.example", got[0].text)
    assert address and not got[0].text.startswith("mü")
    assert re.fullmatch(r"[а-я]{4}\.[а-я]{6}@[a-z]+\.example, [α-ω]{5}@[a-z]+\.example", got[1].text)
    phones = re.fullmatch(r"phone ([0-9]{10}) or Tel\.: ([0-9]{11})", got[2].text)
    assert phones and phones[1] != "5551234567" and phones[2] != "15551234567" and got[2].entity_types == "phone"
    assert got[3].n_entities == 3 and not {"Dupont", "Durand", "Ruiz"} & set(re.findall(r"\w+", got[3].text))
    assert got[4].text == texts[4]


def test_hot_texts_and_entities_come_out_as_others_do(spark, monkeypatch):
    rows = [(k, "Write to a.b@c.org now") for k in range(40)] + [(100 + k, f"Ask a.b@c.org or d{k}@e.org") for k in range(30)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, pii.pseudonymise(docs, "key").collect()))
    monkeypatch.setattr(pii, "HOT", 10)
    assert sorted(map(tuple, pii.pseudonymise(docs, "key").collect())) == plain
    assert len(plain) == len(rows)
