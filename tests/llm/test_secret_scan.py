import base64
import gzip
import random
import re
import time
import urllib.parse
import zlib

import pytest

from arborlake.llm import secret_scan as s

SECRET = "password = hunter2hunter2"


def plain(text):
    """Base spans straight from the patterns."""
    out = []
    for k, (pattern, least, flags) in enumerate([(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, re.I | re.A), (r"AKIA[A-Z0-9]+", 20, 0), (r"[0-9a-f]+", 24, 0)]):
        for m in re.finditer(pattern, text, flags):
            if (len(m[2]) >= 6 if k == 0 else len(m[0]) >= least):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    bits = ["password", "Token", "API_KEY", "apikey", ":", "=", " ", '"', "'", "abc", "abcdef0123", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "ñ", "\n", "\U0001f600", "secretſ", "."]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        assert s.scan(text) == plain(text)
        assert set(s.scan(text)) <= set(s.scan_layers(text)[1])


def wrapped(text):
    yield urllib.parse.quote(text, safe="")
    yield "".join(f"\\u{ord(c):04x}" for c in text)
    yield "".join(f"\\x{ord(c):02x}" for c in text)
    yield base64.b64encode(text.encode()).decode()
    yield base64.urlsafe_b64encode(text.encode()).decode()
    yield base64.b64encode(gzip.compress(text.encode())).decode()
    yield base64.b64encode(zlib.compress(text.encode())).decode()


def test_nested_layers_map_onto_the_stretch_they_came_from():
    for one in wrapped(SECRET):
        for two in [one, *wrapped(one)]:
            text = f"Intro é {two} end"
            at, end = text.index(two), text.index(two) + len(two)
            found = s.scan_layers(text)[1]
            assert any(kind == 0 and at <= a < b <= end for a, kind, b in found), text
            assert SECRET not in s.redact(text) and two not in s.redact(text)
            assert s.redact(text).startswith("Intro é ") and s.redact(text).endswith(" end")


def test_spans_of_escapes_are_exact():
    text = "see pass%77ord%3Dhunter22 now"
    assert s.scan_layers(text)[1] == [(4, 0, 25)]


def test_cycles_and_repeats_end():
    inner = base64.b64encode(b"plain text without anything").decode()
    text = " ".join([inner] * 200 + ["%25" * 300])
    assert s.scan_layers(text)[2] < 20


def test_time_grows_with_the_length():
    for piece in ("token ", "a%", "\\", "AKIA", "A" * 50 + "=", 'password"' + " " * 20):
        spent = []
        for n in (20_000, 80_000):
            text = (piece * n)[:n]
            t = time.process_time()
            s.report(text)
            spent.append(time.process_time() - t)
        assert spent[1] < 0.2 + 12 * spent[0]


def test_query_rows(spark):
    rows = [(1, SECRET, 1), (1, SECRET, 1), (2, None, 1), (3, "", 1), (None, "clean", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(map(tuple, s.scan_documents(frame).drop("layers").collect()), key=str)
    assert got == sorted([(i, *s.report(t)[:5]) for i, t, _ in rows], key=str)
    kept = s.redact_documents(frame)
    assert kept.columns == frame.columns
    assert sorted((r["text"] or "") for r in kept.collect()) == ["", "", s.REDACTED, s.REDACTED, "clean"]
    assert s.scan_documents(frame.limit(0)).collect() == []


def test_nested_copies_are_all_found():
    two = base64.b64encode(base64.b64encode(SECRET.encode())).decode()
    assert two not in s.redact(f"{two} and {two} again")
    assert s.redact(f"{two} and {two} again").count(s.REDACTED) == 2


def test_url_safe_layers_are_read_whole():
    rng = random.Random(2)
    for _ in range(200):
        noise = "".join(rng.choice("abcdefghij klmnop") for _ in range(60))
        one = base64.urlsafe_b64encode(zlib.compress(f"{noise} {SECRET}".encode())).decode()
        if one[0] in "-_":
            continue
        assert one not in s.redact(f"see {one} end"), one


def test_layers_wrapped_over_lines():
    rng = random.Random(7)
    noise = "".join(rng.choice("abcdefghij klmnop") for _ in range(300))
    for raw in (zlib.compress(f"{noise} {SECRET}".encode()), f"{noise} {SECRET}".encode()):
        for end in ("\n", "\n  ", "\r\n"):
            code = base64.b64encode(raw).decode()
            lines = end.join(code[k : k + 38] for k in range(0, len(code), 38))
            out = s.redact(f"see\n{lines}\nThen more")
            assert out == f"see\n{s.REDACTED}\nThen more"


def test_all_of_a_large_or_split_compressed_layer(monkeypatch):
    monkeypatch.setattr(s, "PIECE", 1000)
    for raw in (gzip.compress(b"word " * 1998 + SECRET.encode()), gzip.compress(b"first member") + gzip.compress(SECRET.encode())):
        one = base64.b64encode(raw).decode()
        assert one not in s.redact(f"see {one} end")


HIDDEN = "password=hunter2secret"


@pytest.mark.parametrize(
    "raw",
    [
        b"\x01\x02\x03\x04\x05\x06 " + HIDDEN.encode(),
        b"\xff\xfe\x00" + HIDDEN.encode(),
        HIDDEN.encode("utf-16"),
        HIDDEN.encode("utf-16-be"),
        gzip.compress(b"\x01" * 10 + HIDDEN.encode()),
        gzip.compress(b"ok \xff\xff " + HIDDEN.encode() + b" \x80 ok"),
        zlib.compress(HIDDEN.encode("utf-16")),
        b"\x02\x03" * 20 + base64.b64encode(HIDDEN.encode()) + b"\xf0\xf1",
    ],
)
def test_no_layer_is_dropped_for_its_characters(raw):
    text = "so " + base64.b64encode(raw).decode() + " it is"
    spans = s.scan_layers(text)[1]
    assert (3, 0, len(text) - 6) in spans
    assert HIDDEN not in s.redact(text) and base64.b64encode(raw).decode() not in s.redact(text)


def test_what_lies_across_pieces_is_seen(monkeypatch):
    monkeypatch.setattr(s, "PIECE", 64)
    rng = random.Random(3)
    for k in range(40):
        value = "x" * rng.randrange(6, 300)
        inner = " ".join("word" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 40))) + f" token{' ' * rng.randrange(0, 90)}={' ' * rng.randrange(0, 90)}{value} end"
        if k % 2:
            inner = "a b " + base64.b64encode(inner.encode()).decode() + " c d"
        text = base64.b64encode(zlib.compress(inner.encode())).decode()
        assert [(a, kind, b) for a, kind, b in s.scan_layers(text)[1] if kind == 0] == [(0, 0, len(text))], k


def plain_layers(text, depth=0):
    """All contents below a text, by following every stretch of unwrap() without memory, and what is found in them."""
    found = set(s.scan(text))
    for start, end, decoded, places in s.unwrap(text) if depth < 6 else ():
        found |= s._onto(plain_layers(decoded, depth + 1), start, end, places)
    return found


def test_equals_a_plain_fixpoint():
    rng = random.Random(9)
    wraps = [lambda t: base64.b64encode(t.encode()).decode(), lambda t: "".join(f"%{b:02x}" for b in t.encode()), lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: base64.urlsafe_b64encode(zlib.compress(t.encode())).decode(), lambda t: base64.b64encode(t.encode("utf-16")).decode()]
    for _ in range(60):
        text = rng.choice(["api_key: abcdef12", "AKIA" + "Z9" * 9, "0123456789abcdef" * 2, "nothing here"])
        for _ in range(rng.randrange(0, 4)):
            text = rng.choice(["", "x y ", "é\n"]) + rng.choice(wraps)(text) + rng.choice(["", " z", "\ttail"])
        assert set(s.scan_layers(text)[1]) == plain_layers(text)
