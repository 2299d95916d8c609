import random
import re

import pytest
from pyspark.sql import functions as F

from medlake.llm import pii
from tests.llm.odd import base_rows, docs


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


TEXTS = {
    100: "Mail Ann.Lee+1@mail.example.com, call +1 (212) 555-0951 or +12125550951; card 4111 1111 1111 1111.",
    101: "ann.lee+1@mail.example.com again; 4111111111111111 and 10.0.255.3.",
    102: "not a card 4111111111111112, version 1.2.3, sum 123-45-67890, address 999.1.1.1, a@b, token=abc@",
    103: "SSN 123-45-6789. Mrs. Anna Schmidt met Mr Smith, MR SMITH no; Frau Müller; Dr Who. Госпожа Иванова; Κυρία Παππά.",
    104: "+1 (212) 555-0951",
    105: "x@y.io\n10.0.255.3\n",
}


def texts(spark, clash=True):
    return docs(spark, [(i, t, "en", "s", len(t)) for i, t in TEXTS.items()] + base_rows(), clash)


def run(spark):
    return {r["doc_id"]: r for r in pii.pii_report(texts(spark)).collect()}


def test_types_and_formats(spark):
    got = run(spark)
    assert [got[100][f"n_{k}"] for k in ("email", "phone", "card", "ip")] == [1, 2, 1, 0]
    out = got[100]["text"]
    m = re.fullmatch(r"Mail ([a-z]+\.[a-z]+\+\d@\w+\.example\.(?:com|net|org)), call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1\d{10}); "
                     r"card (4\d{3} \d{4} \d{4} \d{4})\.", out)
    assert m and luhn(m[4]) and m[4] != "4111 1111 1111 1111"
    assert re.sub(r"\D", "", m[2]) == re.sub(r"\D", "", m[3]) != "12125550951"
    # the same entity has the same surrogate elsewhere, in that place's format
    assert m[1] in got[101]["text"] and m[4].replace(" ", "") in got[101]["text"] and got[104]["text"] == m[2]
    ip = re.search(r"and (\d+\.\d+\.\d+\.\d+)\.$", got[101]["text"])[1]
    assert ip != "10.0.255.3" and got[105]["text"].split("\n")[1] == ip
    assert all(0 <= int(x) <= 255 for x in ip.split("."))


def test_what_is_no_entity_stays(spark):
    got = run(spark)
    assert got[102]["text"] == TEXTS[102] and got[102]["n_entities"] == 0
    for row in base_rows():
        assert got[row[0]]["n_entities"] == 0
    assert got[4]["text"] is None and got[5]["text"] == "" and got[11]["text"] == base_rows()[12][1]


def test_names_follow_gender_and_script(spark):
    out = run(spark)[103]["text"]
    m = re.match(r"SSN (\d{3}-\d{2}-\d{4})\. Mrs\. (\w+) (\w+) met Mr (\w+), MR SMITH no; Frau (\w+); Dr (\w+)\. Госпожа (\w+); Κυρία (\w+)\.", out)
    assert m and m[1] != "123-45-6789"
    assert m[2].endswith("na") and m[4].endswith("n") and not m[4].endswith("na") and m[5].endswith("na")
    assert re.fullmatch("[а-я]+на", m[7].lower()) and re.fullmatch("[α-ως]+να", m[8].lower())
    assert "Smith" not in out and "Schmidt" not in out


def test_distinct_entities_stay_distinct(spark):
    """One-letter mailboxes of one domain leave 26 first attempts for 60."""
    names = [f"{a}{b}@tiny.org" for a in "abcdef" for b in "0123456789"]
    rows = [(i, f"to {n} and {names[(i + 1) % len(names)]}", "en", "s", 1) for i, n in enumerate(names)]
    out = pii.pii_report(docs(spark, rows)).collect()
    seen = {}
    for r in out:
        a, b = re.findall(r"\S+@\S+", r["text"])
        seen.setdefault(names[r["doc_id"]], set()).add(a)
        seen.setdefault(names[(r["doc_id"] + 1) % len(names)], set()).add(b)
    assert all(len(v) == 1 for v in seen.values())
    subs = {next(iter(v)) for v in seen.values()}
    assert len(subs) == len(names) and not subs & set(names)


def test_collisions_avoid_real_entities(spark):
    one = spark.createDataFrame([("ssn", "123456789")], "type string, canon string")
    sur = one.select(pii.surrogate(F.col("type"), F.col("canon"), F.lit(0)).alias("s")).first()["s"]
    both = one.union(spark.createDataFrame([("ssn", sur)], "type string, canon string"))
    moved = {r["canon"]: r["attempt"] for r in pii.collisions(both).collect()}
    assert moved["123456789"] == 1


def test_columns_and_empty_table(spark):
    src = texts(spark)
    out = pii.drop_pii(src)
    assert out.columns == src.columns and out.count() == src.count()
    assert {r["pii_types"] for r in out.select("pii_types").distinct().collect()} == {"x-pii_types"}
    assert pii.pii_report(docs(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    out = pii.drop_pii(texts(spark, clash=False))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_collisions_start_no_python(spark):
    real = spark.range(3).selectExpr("'phone' AS type", "concat('+4930', 1000000 + id) AS canon")
    out = pii.collisions(real)
    assert "RDD" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.columns == ["type", "canon", "attempt"] and dict(out.dtypes)["attempt"] == "int" and out.count() == 0


def test_more_names_than_surrogates_of_five_syllables(spark, monkeypatch):
    """With two syllables there are 2^5 names of five; the rounds still settle."""
    monkeypatch.setattr(pii, "SYLLABLES", {s: ["ba"] * 8 + ["be"] * 8 for s in pii.SYLLABLES})
    names = [f"n:name{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in range(60)]
    ents = spark.createDataFrame([("name", n) for n in names], "type string, canon string")
    moved = {r["canon"]: r["attempt"] for r in pii.collisions(ents).collect()}
    used = spark.createDataFrame([(n, moved.get(n, 0)) for n in names], "canon string, attempt int")
    got = [r["s"] for r in used.select(pii.surrogate(F.lit("name"), F.col("canon"), F.col("attempt")).alias("s")).collect()]
    assert len(set(got)) == len(names) and not set(got) & set(names)


def people(spark, rows):
    table = docs(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(rows)])
    return [r["text"] for r in sorted(pii.pii_report(table).collect(), key=lambda r: r["doc_id"])]


def test_one_person_whatever_the_title(spark):
    out = people(spark, ["Mr John Smith came. Dr John Smith spoke. Later John Smith and JOHN SMITH left; Then John Smith's dog.",
                         "Prof. John Smith", "John Smith without a title in this document", "Mrs Ann Lee, Mr Ann Lee, Dr Ann Lee"])
    m = re.fullmatch(r"Mr (\w+ \w+) came\. Dr (\w+ \w+) spoke\. Later (\w+ \w+) and (\w+ \w+) left; Then (\w+ \w+)'s dog\.", out[0])
    assert m and len({g.lower() for g in m.groups()}) == 1 and m[1].lower() != "john smith" and m[4].isupper()
    assert out[1] == f"Prof. {m[1]}" and out[2].startswith("John Smith without")
    # a man and a woman of one name: three people, as no one can tell
    assert len(set(re.findall(r"(?:Mrs|Mr|Dr) (\w+ \w+)", out[3]))) == 3


def test_names_of_several_parts(spark):
    out = people(spark, ["Mr. José-María López ran", "Mrs. O'Brien and Señora García met", "Mr Smith-Jones, then Smith-Jones and Smith"])
    assert re.fullmatch(r"Mr\. [A-Z]\w+-[A-Z]\w+ [A-Z]\w+ ran", out[0]) and not re.search("José|María|López", out[0])
    assert not re.search("Brien|Garc", out[1])
    m = re.fullmatch(r"Mr (\w+-\w+), then (\w+-\w+) and Smith", out[2])
    assert m and m[1] == m[2] != "Smith-Jones"


def test_phones_keep_country_codes(spark):
    out = people(spark, ["+44 20 7946 0958 and +442079460958, +351 21 123 4567", "555-123-4567 or (555) 123-4567", "part 555-123-45678, 1-555-123-4567-9"])
    m = re.fullmatch(r"(\+44 \d\d \d{4} \d{4}) and (\+44\d{10}), (\+351 \d\d \d{3} \d{4})", out[0])
    assert m and re.sub(" ", "", m[1]) == m[2] != "+442079460958"
    a, b = out[1].split(" or ")
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "5551234567" and re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", b)
    assert out[2] == "part 555-123-45678, 1-555-123-4567-9"


def test_random_corpora_keep_people_apart(spark):
    """Against a plain reading of each text: equal people stay equal, others differ."""
    rng = random.Random(7)
    given, last = ["John", "Anna", "Ivan", "Zoë", "Li"], ["Smith", "Schmidt", "García", "Novak"]
    rows, who = [], []
    for _ in range(60):
        said = [(rng.choice(["Mr", "Dr", "Prof"]), f"{rng.choice(given)} {rng.choice(last)}") for _ in range(rng.randint(1, 4))]
        parts = [f"{t} {n}" for t, n in said] + [n for _, n in said if rng.random() < 0.5]
        rows.append(" met ".join(parts) + ".")
        who.append([n for _, n in said] + [p for p in parts[len(said):]])
    men = {n for r in rows for n in re.findall(r"Mr (\w+ \w+)", r)}
    seen = {}
    for text, names in zip(people(spark, rows), who, strict=True):
        got = [re.sub(r"^(?:Mr|Dr|Prof) ", "", p) for p in text[:-1].split(" met ")]
        assert len(got) == len(names)
        for a, b in zip(names, got, strict=True):
            seen.setdefault(a, set()).add(b)
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)
    assert not set(seen) & {next(iter(v)) for v in seen.values()}
    assert all(next(iter(v)).split()[0].endswith("n") for n, v in seen.items() if n in men)


def test_a_full_space_raises_and_a_tight_one_settles(spark, monkeypatch):
    """Ten values for addresses, of which four are free of real ones."""
    ten = lambda kind, canon, attempt, key=pii.KEY: F.concat(F.lit("v"), F.pmod(F.xxhash64(canon, attempt), F.lit(10)).cast("string"))
    monkeypatch.setattr(pii, "surrogate", ten)
    monkeypatch.setattr(pii, "STALLED", 12)
    make = lambda names: spark.createDataFrame([("ip", n) for n in names], "type string, canon string")
    pii.collisions(make(["a", "b", "c", "v1", "v2"]))
    with pytest.raises(RuntimeError):
        pii.collisions(make(["a", "b", "c"] + [f"v{i}" for i in range(10)]))
