import hashlib
import random
import re
import string

from medlake.llm import secret_scan as ss
from tests.llm.odd import base_rows, docs

PATTERNS = [("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
            ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16)]


def brute(text):
    out = []
    for k, (name, p, group, least) in enumerate(PATTERNS):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(p, text or "") if len(m[group]) >= least]
    return sorted(out)


rng = random.Random(9)
KEYS = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(20)]
TEXTS = [
    "password: abcdefghijkl", "Token = 'abc.def-ghi_jkl=='", "token: password: abcdefghijklmnop", "secret=secret=abcdefghijkl x",
    "API_KEY:\"0123456789abcdef0123\"", "é\U0001f600 AKIAABCDEFGHIJ2345 AKIASHORT1 xAKIAABCDEFGHIJ23456", "0123456789abcdef0 0123456789abcde",
    "ſecret=abcdefghijklmn toKen=abcdefghijklmn", "passwd  =  short", "apikey=" + "a" * 12, "password\n=abcdefghijklmnop",
    "deadbeefdeadbeefg" * 3, "AKIA" * 6, "use " + KEYS[0] + " now", "path/to/some2/very-long-directory-name/with/many/parts",
    "aaaaaaaaaaaaaaaaaaaaaaaaa1aaaaaaaaaaaaaaaaaaaaaaaaa", "1234567890123456789012345678901234567890",
]


def test_base_spans_of_odd_texts(spark):
    rows = [(100 + i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + base_rows()
    got = {}
    for r in ss.secret_report(docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).add((r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]))
    for i, t, *_ in rows:
        want = brute(t)
        n = [sum(w[1] == k for w in want) for k in range(3)]
        digest = hashlib.sha256(",".join(f"{w[3]}:{w[0]}:{w[2]}" for w in want).encode()).hexdigest()
        assert (*n, digest) in got[i], (i, t, want)


def test_battery_tells_keys_from_text(spark):
    plain = ["some1-long-hyphenated-" + w for w in ("identifier-of-a-module", "name-with-many-many-parts", "path-in-the-tree-of-files")]
    runs = ["ab1" * 20, "x" * 30 + "1", "aaaabbbbccccddddeeee1111" * 2, "abcdefghijklmnopqrstuvwxyz0123456789"]
    rows = [(i, f"see {t} here", "en", "s", 1) for i, t in enumerate(KEYS + plain + runs)]
    got = {r["doc_id"]: r["spans"] for r in ss.secret_report(docs(spark, rows)).collect()}
    found = [i for i, s in got.items() if "random:" in s]
    assert sum(i < len(KEYS) for i in found) >= 18
    assert not [i for i in found if i >= len(KEYS) + len(plain)]
    assert all(got[i] == f"random:4:{4 + len(KEYS[i])}" for i in found if i < len(KEYS))


def test_limits_follow_the_step_up_rule():
    counts = {0: {0: 90, 60: 10}, 1: {0: 5}}
    got = ss.p_limits(counts)
    assert got[0] == 10.0 ** -3 and got[1] == 0.0


def test_empty_table(spark):
    assert ss.secret_report(docs(spark, [])).count() == 0


def test_keys_after_paths_are_candidates():
    """A run that mixes the symbols of both base64 alphabets is split."""
    r = random.Random(3)
    key = lambda extra: "".join(r.choice(string.ascii_letters + string.digits + extra) for _ in range(40))
    plain = hits = 0
    for _ in range(200):
        k = key("")
        for text in (f"see https://host.example/v1/my-service/{k} now", f"/a_b/{k}/c-d", f"é x-y/{k}"):
            got = ss.candidates(text, [])
            spans = [text[c["start"]:c["stop"]] for c in got if k in text[c["start"]:c["stop"]]]
            assert len(spans) == 1, text
            hits += spans[0] == k
            plain += 1
    assert hits > 0.85 * plain
    safe, std = "A1b" + key("-_")[3:-1] + "z", "A1b" + key("+/")[3:-1] + "z"
    assert [c["stop"] - c["start"] for c in ss.candidates(f"/hooks/my-app/{safe}", [])] == [40]
    assert any(c["stop"] - c["start"] >= ss.LEAST for c in ss.candidates(f"my_app-{std}", []))
    assert ss.candidates(f"/v1/my-service/{k}", [(5, 0, 60)]) == []
