"""Plain versions of the text operators, for small inputs."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

VISIBLE = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = {c: c + 32 for c in range(65, 91)}
BLANK = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lines(docs):
    key = lambda line: line.strip(BLANK).translate(FOLD)
    owner = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), d), d)
    out = []
    for d, t in docs:
        cut = (t or "").split("\n")
        kept = [x for x in cut if len(key(x)) < 10 or owner[key(x)] == d]
        out.append((d, len(cut), len(cut) - len(kept), sha("\n".join(kept))))
    return out


def near(docs):
    sets = {}
    for d, t in docs:
        w = VISIBLE.findall((t or "").translate(FOLD))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    common = Counter(p for ds in by.values() for p in combinations(sorted(ds), 2))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [(d, len(sets[d]), find(d), find(d) == d) for d in sets]


def secrets(docs):
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + "|" + either("api") + "_?" + either("key")
    assign = re.compile(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = [("assign", assign, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    out = []
    for d, t in docs:
        found = [
            (m.start(), i, k, m.end())
            for i, (k, p, g, least) in enumerate(kinds)
            for m in p.finditer(t or "")
            if len(m[g]) >= least
        ]
        out.append((d, *_counted(found, [k[0] for k in kinds])))
    return out


def _counted(found, kinds):
    n = Counter(f[2] for f in found)
    return (*[n[k] for k in kinds], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))))


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def personal(docs):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for d, t in docs:
        found = []
        for i, (k, p) in enumerate(kinds.items()):
            for m in re.finditer(p, t or ""):
                digits = re.sub("[^0-9]", "", m[0])
                good = {
                    "email": True,
                    "ip": k != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn(digits),
                    "phone": 9 <= len(digits) <= 15,
                }[k]
                if good:
                    found.append((m.start(), i, k, m.end()))
        out.append((d, *_counted(found, list(kinds))))
    return out


def substrings(docs, span=13):
    words = [(d, VISIBLE.findall(t or "")) for d, t in docs]
    owner = {}
    for d, w in words:
        for i in range(len(w) - span + 1):
            x = tuple(w[i : i + span])
            owner[x] = min(owner.get(x, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - span + 1):
            if owner[tuple(w[i : i + span])] < d:
                gone |= set(range(i, i + span))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), sha(kept)))
    return out


def contamination(docs, items, span=13):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(FOLD))
        n = min(span, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add(i)
    lengths = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(FOLD))
        hit, met = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    met |= windows[tuple(w[k : k + n])]
        names = sorted(str(i) for i in met if i is not None)
        bad = bool(hit) and 20 * len(hit) >= len(w)
        out.append((d, len(w), len(hit), len(names), sha(",".join(names)), bad))
    return out


def quality(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = VISIBLE.findall(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        full = [x for x in t.split("\n") if VISIBLE.search(x)]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        symbols = sum(c in "#*$%&|<>" for c in t)
        out.append((d, len(w), sum(map(len, w)), symbols, len(full) - len(set(full)), len(again), failed))
    return out


def quality_kept(docs, prior=200.0):
    """Ids of the rows (id, text, lang, source) that pass the base rule and the fences of their source."""
    step = math.log(1.02)
    marks = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    rows = []
    for (d, n, chars, symbols, dup, again, failed), (_, t, lang, source) in zip(quality([x[:2] for x in docs]), docs):
        lines_ = sum(bool(VISIBLE.search(x)) for x in (t or "").split("\n"))
        if not failed:
            odds = [(symbols, chars), (dup, lines_), (again, n)]
            plain = [chars / n, sum(c in marks for c in t) / chars]
            rows.append((d, lang or "", source or "", plain + [a / (b - a + 0.5) if a else None for a, b in odds]))

    def bins(values):
        return Counter(-100_000 if v == 0 else math.ceil(math.log(v) / step) for v in values)

    def merged(own, parent):
        out, total = Counter({b: 1000 * n for b, n in own.items()}), sum(parent.values())
        for b, n in parent.items():
            out[b] += round(1000 * prior) * n // total
        return out

    kept = {r[0] for r in rows}
    for m in range(5):
        known = [r for r in rows if r[3][m] is not None]
        whole = bins(r[3][m] for r in known)
        for lang in {r[1] for r in rows}:
            mine = merged(bins(r[3][m] for r in known if r[1] == lang), whole)
            for source in {r[2] for r in rows if r[1] == lang}:
                own = merged(bins(r[3][m] for r in known if r[1:3] == (lang, source)), mine)
                edges, upto = [], 0
                for b in sorted(own):
                    upto += own[b]
                    edges += [b] * (4 * upto // max(1, sum(own.values())) - len(edges))
                if not edges:
                    continue
                low, high = edges[0] - 1, edges[2]
                low, high = (low * step, high * step) if m > 1 else (1.02**low, 1.02**high)
                reach = (2 if m > 1 else 5) * (high - low)
                for r in known:
                    v = math.log(r[3][m]) if m > 1 else r[3][m]
                    if reach and r[1:3] == (lang, source) and (v > high + reach or m == 0 and v < low - reach):
                        kept.discard(r[0])
    return kept


def warc(pages):
    largest = {}
    for p, h in pages:
        largest[h or ""] = max(largest.get(h or "", p), p)
    out = []
    for p, h in pages:
        body, top = (h or "").encode(), largest[h or ""]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((p, len(body), digest, "response" if p == top else "revisit", None if p == top else top))
    return out


def url_parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(FOLD), re.match(r"[^?#]*", rest[len(host) :])[0]


def urls(pages, rules, threshold=1.0, damping=0.85, steps=20):
    """(page_id, host, path, rule, verdict) of (page_id, url, linked hosts)."""
    judged, links = [], Counter()
    trusted, blocked = Counter(), Counter()
    for page, url, linked in pages:
        host, path = url_parts(url)
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        rule = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        judged.append((page, host, path, rule))
        if host:
            if rule:
                (trusted if rule[2] == "allow" else blocked)[host] += 1
            links.update((host, other) for other in set(linked) - {host})
    hosts = {h for h in trusted} | {h for h in blocked} | {h for e in links for h in e}
    out, into = Counter(), Counter()
    for (a, b), n in links.items():
        out[a] += n
        into[b] += n
    trust, distrust = ({h: (1 - damping) * s[h] for h in hosts} for s in (trusted, blocked))
    for _ in range(steps):
        t, d = ({h: (1 - damping) * s[h] for h in hosts} for s in (trusted, blocked))
        for (a, b), n in links.items():
            t[b] += damping * trust[a] * n / out[a]
            d[a] += damping * distrust[b] * n / into[b]
        trust, distrust = t, d
    rows = []
    for page, host, path, rule in judged:
        t, d = trust.get(host, 0.0), distrust.get(host, 0.0)
        verdict = rule[2] if rule else "block" if d - threshold * t > 1e-9 * (t + d) else "allow"
        rows.append((page, host, path, rule and rule[0] + rule[1], verdict))
    return rows


def spelling_words(docs, typo_every=199, min_chars=6, min_count=5):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if typo_every and h % typo_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def spellings(words, ratio=5):
    """(word, n, n_near, form, form_n, root), by trying every edit of every word."""
    letters = {c for w in words for c in w}
    form, near = {}, {}
    for w in words:
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        edits = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters}
        edits |= {a + c + b[1:] for a, b in cuts if b for c in letters}
        near[w] = [x for x in edits - {w} if x in words]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return [(w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items()]


def alignment(docs, encode_a, encode_b, bytes_a, bytes_b):
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) by comparing byte ranges."""
    made, holders = [], Counter()
    for d, t in docs:
        raw = (" " + (t or "")).encode()
        ids = [encode_a(t), encode_b(t)] if t else [[], []]
        if any(b"".join(table[i] for i in x) != raw for table, x in zip((bytes_a, bytes_b), ids)):
            ids = [[], []]
        spans = []
        for table, x in zip((bytes_a, bytes_b), ids):
            at, side = 0, []
            for i in x:
                side.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(side)
        shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        written, low = [], 0
        for cut in shared:
            written.append("|".join(",".join(str(i) for _, e, i in side if low < e <= cut) for side in spans))
            low = cut
        links, j = [], 0
        for s, e, i in spans[0]:
            while j and spans[1][j][0] > s:
                j -= 1
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        holders.update(set(links))
        digest = hashlib.sha256(";".join(written).encode()).hexdigest() if written else ""
        made.append((d, len(ids[0]), len(ids[1]), len(shared), digest, links))
    highest = Counter()
    for (i, _), n in holders.items():
        highest[i] = max(highest[i], n)
    return [
        (d, a, b, g, len(links), digest, sum(holders[p] == highest[p[0]] for p in links), sum(holders[p] for p in links))
        for d, a, b, g, digest, links in made
    ]
