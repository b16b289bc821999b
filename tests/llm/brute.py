"""Plain versions of the operators, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(rows, window=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out[i] = (len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g)))
    return out


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_components(rows, n=3, percent=90):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    links, by = [], {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    near = {}
    for group in by.values():
        for x in group:
            for y in group:
                if x < y:
                    near[x, y] = near.get((x, y), 0) + 1
    for (x, y), same in near.items():
        if 100 * same >= percent * (len(sets[x]) + len(sets[y]) - same):
            links.append((x, y))
    comp = components(sets, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def exact_dedup(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(i)
    return {i: (max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g}


ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    rank = ["assign", "access", "hex"]
    found.sort(key=lambda x: (x[1], rank.index(x[0])))
    counts = tuple(sum(k == kind for k, _, _ in found) for kind in rank)
    return counts, sha(",".join(f"{k}:{a}:{b}" for k, a, b in found)), found


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        after = [i]
        for j, y in enumerate(b, 1):
            after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (x != y)))
        row = after
    return row[-1]


def line_dedup(rows, threshold=2, least=20):
    strip = " \t\n\x0b\x0c\r"
    split = lambda t: [] if t is None else t.split("\n")
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate(x.strip(strip) for x in split(t)):
            if line:
                first.setdefault(line, (i, k))
    lines = sorted((x for x in first if len(x) >= least), key=len)
    signs = [{c: line.count(c) for c in set(line[:2000])} for line in lines]
    links = []
    for x in range(len(lines)):
        for y in range(x + 1, len(lines)):
            if len(lines[y]) - len(lines[x]) > threshold:
                break
            apart = sum(abs(signs[x].get(c, 0) - signs[y].get(c, 0)) for c in signs[x].keys() | signs[y].keys())
            if apart <= 2 * threshold and edit_distance(lines[x], lines[y]) <= threshold:
                links.append((lines[x], lines[y]))
    kind, head = {x: x for x in first} | components(lines, links), {}
    for line, place in first.items():
        head[kind[line]] = min(head.get(kind[line], place), place)
    out = {}
    for i, t in rows:
        own = split(t)
        kept = [x for k, x in enumerate(own) if not x.strip(strip) or head[kind[x.strip(strip)]] == (i, k)]
        out[i] = (len(own), len(own) - len(kept), sha("\n".join(kept)))
    return out


def leak_templates(text):
    """(first words plain, first words as names, literal) token lists and the raw words, for decontamination."""
    import regex

    from quillon.llm import decontaminate as D

    spaced = regex.sub(" +", " ", (text or "").translate({ord(c): " " for c in D._GAPS}))
    marked = regex.sub(r"\p{N}+(?:[.,:/]\p{N}+)*", D.NUMBER, spaced)
    marked = regex.sub(rf"{D.NUMBER}( ?)(?i:{D.UNITS})(?![\p{{L}}{D.NUMBER}])", rf"{D.NUMBER}\1{D.UNIT}", marked)
    letter = lambda c: bool(regex.match(rf"[\p{{L}}{D.NUMBER}{D.UNIT}]", c))
    plain, named, at = "", "", 0
    for m in regex.finditer(rf"\p{{Lu}}\p{{Ll}}+(?![\p{{L}}{D.NUMBER}])", marked):
        before = marked[max(0, m.start() - 2) : m.start()]
        if before and letter(before[-1]):
            continue
        inside = len(before) == 2 and before[1] == " " and (letter(before[0]) or before[0] in ",;")
        plain += marked[at : m.start()] + (D.NAME if inside else m[0])
        named += marked[at : m.start()] + D.NAME
        at = m.end()
    plain, named = plain + marked[at:], named + marked[at:]
    clean = lambda t: regex.sub(rf"[^\p{{L}}{D.NUMBER}-{D.NAME} ]+", "", t).lower().split()
    literal = regex.sub(r"[^\p{L}\p{N} ]+", "", spaced).upper().lower().split()
    return (clean(plain), clean(named), literal), [w for w in spaced.split(" ") if regex.search(r"[\p{L}\p{N}]", w)]


def leaks(docs, items, window=8, least=13, words=4):
    """(doc_id, item_id) of every item that has leaked, by comparing all diagonals."""
    import regex

    from quillon.llm import decontaminate as D

    slot = lambda t: bool(regex.search(rf"[{D.NUMBER}-{D.NAME}]", t))
    plain_words = lambda ts: len({t for t in ts if not slot(t) and not regex.search(r"\p{N}", t)})
    bare = lambda w: regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w.lower())
    known = {i: leak_templates(t) for i, t in items}
    starts = {}
    for i, (kinds, _) in known.items():
        for k, tokens in enumerate(kinds):
            size = min(window, len(tokens))
            for p in range(len(tokens) - size + 1) if size else ():
                starts.setdefault((k, tuple(tokens[p : p + size])), []).append((i, p))
    sizes = {len(w) for _, w in starts}
    out = set()
    for d, text in docs:
        kinds, raw = leak_templates(text)
        for k, tokens in enumerate(kinds):
            met = {}
            for size in sizes:
                for q in range(len(tokens) - size + 1):
                    for i, p in starts.get((k, tuple(tokens[q : q + size])), ()):
                        met.setdefault((i, q - p), set()).add(p)
            for (i, shift), places in met.items():
                own, own_raw = known[i][0][k], known[i][1]
                size = min(window, len(own))
                if not any(plain_words(own[p : p + size]) for p in places) or len(own_raw) != len(own):
                    continue
                strong = {p for p in places if plain_words(own[p : p + size]) >= words} if size == window else set()
                for windows in (places, strong):
                    for p in windows:
                        if p - 1 in windows:
                            continue
                        n = size
                        while p + n - size + 1 in windows:
                            n += 1
                        run = own[p : p + n]
                        if n < min(least, len(own)) or plain_words(run) < (1 if k == D.LITERAL else words):
                            continue
                        pairs = {(bare(a), bare(b)) for a, b, t in zip(own_raw[p : p + n], raw[p + shift : p + shift + n], run, strict=True) if slot(t)}
                        if len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
                            out.add((d, i))
    return out
