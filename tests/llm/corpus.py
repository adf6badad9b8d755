"""A small table of awkward documents, and plain restatements of what the operators compute."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, id string, slice string, n_words string, spans string"


def words(text):
    return WORD.findall(text or "")


def texts():
    rnd = random.Random(7)
    vocabulary = {lang: ["".join(rnd.choice(s) for _ in range(rnd.randint(1, 3))) for _ in range(900)] for lang, s in
                  {"en": ["the", "on", "ing", "er", "at", "wh"], "de": ["sch", "ü", "ung", "keit", "ß", "ver"], "fr": ["é", "eau", "ou", "ment", "è", "que"]}.items()}

    def prose(lang, n):
        out = []
        for k in range(n):
            out.append(rnd.choice(vocabulary[lang]) + ("." if k % 11 == 10 else ""))
        return " ".join(out).replace(". ", ".\n")

    passage, line = prose("en", 70), "All rights reserved by the holder."
    rows = []
    for k in range(60):
        lang = ("en", "de", "fr")[k % 3]
        rows.append((prose(lang, rnd.randint(20, 300)), lang, f"src{k % 4}"))
    base = rows[0][0].split(" ")
    for k in range(12):  # near copies
        w = list(base)
        w[rnd.randrange(len(w))] = f"edit{k}"
        rows.append((" ".join(w), "en", "src0"))
    rows += [rows[5], rows[5], rows[7]]  # copies
    for k in range(8):  # a shared passage
        rows.append((prose("en", 40) + "\n" + passage + "\n" + prose("en", 30), "en", "src1"))
    for k in range(30):  # a shared line
        rows.append((prose("de", 60) + "\n" + line + "\n" + prose("de", 20), "de", "src2"))
    rows += [(line, "en", "src2"), (f"{line}\nand six more words of its own", "en", "src2")]
    rows += [
        ("mail a.b+c@mail.example.com, x_d@e.f or a@b.c_d@e.f and a@b", "en", "src0"),
        ("from 10.0.0.256 to 1.2.3.4.5.6.7.8 or 001.002.003.255 v1.2.3", "en", "src0"),
        ("card 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 4111111111111111", "en", "src0"),
        ("call +1 (310) 555-4510 or +49 30 (12) 34 or +1234567890123456 now", "en", None),
        ('é token = "0123456789abcdef0123456789abcdef01234567" 日本 😀 user (at) mail (dot) org', "en", "src3"),
        ("7" * 5000 + " " + "1 " * 3000 + "a@" * 2000, None, "src3"),
        ("a" * 60000, None, "src3"), (prose("fr", 40000), "fr", "src3"),
        ("<|endoftext|> it's<|startoftext|>HE'LL \x00 \x1c 　 ſ İ Σ é", None, "src3"),
        ("one", "en", "src0"), ("ONE", "en", "src1"), ("", "en", "src0"), (" \n\t ", "en", None), (None, "en", "src1"), (None, None, None), ("12 34 !!", None, "src1"),
        ("same same same same same same same same same same same same same same same same same same", "en", "src1"),
    ]
    return rows


def documents():
    rows = [(3 * k + 1, t, lang, source, None if t is None else len(t), "big", None, "x", "y", "z", "w") for k, (t, lang, source) in enumerate(texts())]
    rows.append(rows[4])                                  # a repeated row
    rows.append((None, rows[9][1], "en", "src0", 1, None, None, None, None, None, None))  # no id, a copy
    rows.append((None, "a row without an id that is like no other row", "en", "src0", 1, None, None, None, None, None, None))
    return rows


def repeated_words(rows, length=13):
    first = {}
    for key, text in sorted(((k if k is not None else 1 << 62), words(t)) for k, t in rows):
        for i in range(len(text) - length + 1):
            first.setdefault(tuple(text[i : i + length]), key)
    out = []
    for key, text in rows:
        w, gone = words(text), set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (key if key is not None else 1 << 62):
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repeated_bytes(rows, length=200):
    seen = Counter()
    data = [(k, (t or "").encode()) for k, t in rows]
    for _, b in data:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for key, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((key, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def near_components(rows):
    """Per row (key, set size, component); rows without an id have keys above all others."""
    keyed = [(k if k is not None else (1 << 62) + i, t) for i, (k, t) in enumerate(rows)]
    sets = {}
    for k, t in keyed:
        w = (t or "").encode().translate(LOWER).split()
        sets[k] = set(zip(w, w[1:])) if len(w) > 1 else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists, common = defaultdict(list), Counter()
    for k, s in sets.items():
        for x in s:
            lists[x].append(k)
    for own in lists.values():
        for i, a in enumerate(own):
            common.update((a, b) for b in own[i + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    out = []
    for (k, _), (key, _) in zip(keyed, rows):
        top = root(k)
        out.append((key, len(sets[k]), top if top < 1 << 62 else key))
    return out


def held_out(key, parts, part):
    return zlib.crc32(b"" if key is None else str(key).encode()) % parts == part


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    patterns = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t, d: all(int(x) <= 255 for x in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t, d: 16 <= len(d) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t, d: 8 <= len(d) <= 15),
    )
    return [(kind, m.start(), m.end()) for kind, p, ok in patterns for m in re.finditer(p, text or "") if ok(m.group(), re.sub("[^0-9]", "", m.group()))]


def line_figures(text):
    text = text or ""
    w, seen, again = words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(cover)
