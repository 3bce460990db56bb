"""Plain-Python models of the documented semantics, written for clarity and used as brute force."""

import math
import re
import unicodedata
from collections import Counter

WS = {chr(c) for c in (*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)}
WS_STR = "".join(WS)
STOP = set(
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will "
    "would could should may might shall can need must it its this that these those i you he she we they me him her us "
    "them my your his our their not no so if as just about".split()
)


def units(s):
    return len(s.encode("utf-16-le", "surrogatepass")) // 2


def is_cjk(ch):
    return 0x3000 <= ord(ch) <= 0x9FFF or 0xF900 <= ord(ch) <= 0xFAFF


def est(s):
    cjk = sum(map(is_cjk, s))
    return math.ceil(cjk / 1.5 + (units(s) - cjk) / 4)


def tokens(text):
    classes = []
    for ch in text:
        kind = "cjk" if is_cjk(ch) else "gap" if ch in WS or unicodedata.category(ch).startswith("P") else "word"
        if classes and classes[-1][0] == kind:
            classes[-1][1].append(ch)
        else:
            classes.append((kind, [ch]))
    out = []
    for kind, chars in classes:
        run = "".join(chars)
        if kind == "cjk":
            out += [run[i : i + 2] for i in range(len(run) - 1)]
        elif kind == "word":
            low = run.lower()
            if low not in STOP and units(low) > 1:
                out.append(low)
    return out


def trim(s):
    return s.strip(WS_STR)


def heading_of(line):
    m = re.match("^(#{1,6})[" + re.escape(WS_STR) + "]", line)
    return trim(line.lstrip("#")) if m else None


def scan(lines):
    """(line, inside code after this line's own fence, heading or None) per line."""
    code = False
    for line in lines:
        if line.lstrip(WS_STR).startswith("```"):
            code = not code
        yield line, code, None if code else heading_of(line)


def spans(body, strategy, max_tokens):
    lines = body.split("\n")
    out, first, held, used, heading = [], 0, 0, 0, None
    for i, (line, code, found) in enumerate(scan(lines)):
        if strategy == "paragraph":
            heading = heading if found is None else found
            if trim(line) == "" and not code:
                if held:
                    out.append((first, i - 1, heading))
                first, held = i + 1, 0
            else:
                held += 1
        elif strategy == "fixed":
            heading = heading if found is None else found
            if held and used + est(line) > max_tokens and not code:
                out.append((first, i - 1, heading))
                first, held, used = i, 1, est(line)
            else:
                held, used = held + 1, used + est(line)
        else:
            if found is not None:
                if held:
                    out.append((first, i - 1, heading))
                first, heading = i, found
            held += 1
    if held:
        out.append((first, len(lines) - 1, heading))
    texts = [(trim("\n".join(lines[a : b + 1])), h, a, b) for a, b, h in out]
    return [t for t in texts if t[0]]


def resplit(chunk, max_tokens):
    text, heading, start, end = chunk
    lines = text.split("\n")
    groups, cur, used = [], [], 0
    for i, line in enumerate(lines):
        if cur and used + est(line) > max_tokens:
            groups.append(cur)
            cur, used = [], 0
        cur.append(i)
        used += est(line)
    groups.append(cur)
    out = []
    for g in groups:
        t = trim("\n".join(lines[g[0] : g[-1] + 1]))
        if t:
            out.append((t, heading, start + g[0], end if g[-1] == len(lines) - 1 else start + g[-1]))
    return out


def frontmatter(content):
    """(metadata in order, is_list, body, body start line)."""
    t = content.lstrip(WS_STR)
    end = t.find("\n---", 3) if t.startswith("---") else -1
    if end < 0:
        return {}, {}, content, 0
    body = t[end + 4 :]
    body = body[1:] if body.startswith("\n") else body
    unquote = lambda v: re.sub("[\"']$", "", re.sub("^[\"']", "", v)) if v not in ("'", '"') else ""
    values, listy, key, items = {}, {}, "", None

    def close():
        if key and items is not None:
            values[key], listy[key] = items, True

    for raw in trim(t[4:end] if end > 4 else "").split("\n"):
        line = trim(raw)
        if not line or line.startswith("#"):
            continue
        if line.startswith("- ") and key and items is not None:
            items.append(trim(line[2:]))
            continue
        at = line.find(":")
        if at > 0:
            close()
            key, value = trim(line[:at]), trim(line[at + 1 :])
            if value in ("", "[]"):
                items = []
                continue
            if value.startswith("[") and value.endswith("]"):
                values[key], listy[key] = [x for x in (unquote(trim(p)) for p in value[1:-1].split(",")) if x], True
            else:
                values[key], listy[key] = [unquote(value)], False
            key, items = "", None
    close()
    before = content[: max(content.find(body), 0)]
    return values, listy, body, before.count("\n")


def chunks(content, strategy, max_tokens):
    _, _, body, base = frontmatter(content)
    if not trim(body):
        return []
    out = []
    for text, heading, a, b in spans(body, strategy, max_tokens):
        c = (text, heading, a + base, b + base)
        out += [c] if est(text) <= max_tokens else resplit(c, max_tokens)
    return [(i, *c, est(c[0])) for i, c in enumerate(out)]


def tf(tk):
    counts = Counter(tk)
    top = max(counts.values(), default=1)
    return {k: v / top for k, v in counts.items()}


def text_search(docs, query, k, min_score):
    """docs: {id: text}; (id, score) best first, ties by id."""
    n = len(docs)
    vectors = {d: tf(tokens(t)) for d, t in docs.items()}
    df = Counter(t for v in vectors.values() for t in v)
    idf = {t: math.log((n + 1) / (c + 1)) + 1 for t, c in df.items()}
    weigh = lambda v: {t: x * idf.get(t, math.log(n + 1)) for t, x in v.items()}
    q_tokens = tokens(query)
    if not q_tokens:
        needle = trim(query).lower()
        if not needle:
            return []
        scored = []
        for d, t in docs.items():
            count = t.lower().count(needle)
            if count:
                scored.append((d, round(min(1.0, count * units(needle) / max(units(t.lower()), 100)), 9)))
    else:
        q = weigh(tf(q_tokens))
        scored = []
        for d, v in vectors.items():
            w = weigh(v)
            norm = math.sqrt(sum(x * x for x in q.values())) * math.sqrt(sum(x * x for x in w.values()))
            score = round(sum(x * w.get(t, 0.0) for t, x in q.items()) / norm, 9) if norm else 0.0
            if score >= min_score:
                scored.append((d, score))
    return sorted(scored, key=lambda r: (-r[1], r[0]))[:k]


def cosine(q, v):
    n = min(len(q), len(v))
    dot = sum(q[i] * v[i] for i in range(n))
    norm = math.sqrt(sum(x * x for x in q)) * math.sqrt(sum(x * x for x in v[:n]))
    return dot / norm if norm else 0.0


def pack(items, budget, cap=None):
    """items: [(key, tokens)] in order; greedy with skip."""
    seen, used, out = set(), 0, []
    for key, size in items:
        if key in seen:
            continue
        seen.add(key)
        if cap is not None and (len(out) >= cap or used >= budget):
            break
        if used + size <= budget:
            used += size
            out.append(key)
    return out


def diff(old, new):
    a, b = old.split("\n"), new.split("\n")
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            out.insert(0, ("same", a[i - 1]))
            i, j = i - 1, j - 1
        elif j and (i == 0 or table[i][j - 1] >= table[i - 1][j]):
            out.insert(0, ("add", b[j - 1]))
            j -= 1
        else:
            out.insert(0, ("remove", a[i - 1]))
            i -= 1
    return out
