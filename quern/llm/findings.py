"""Labelled findings for the secret scan, made from a seed: strings in their surroundings, true secrets and look-alikes.

A finding is (text before, candidate, text after, path, label). Own labelled findings may be given to the scan instead.
"""

from __future__ import annotations

import base64
import random

WORDS = """about above access account action active address after again agent alert alias allow amount analysis answer
apply archive array author backup balance basic batch before begin between binary block board boolean border bottom
branch bridge broken browser buffer build bundle button cache callback cancel center change channel chapter check child
class clean clear client cloud cluster code collect color column command comment commit common compare compile complete
component config connect console constant contact container content context control copy core count create credit
current custom customer data database date debug decision decode default define delete deploy design detail device
direct disable discover display document domain double download draft driver dynamic editor effect element email empty
enable encode engine enter entry error event example execute expand export extend factory failed feature field figure
file filter final first fixed flag float folder follow footer force format forward frame function future gateway general
generate global graph group handle handler header height hello history home host image import include index info
initial inner input insert install instance integer interface internal issue item join json kernel keyboard label large
latest layer layout left length level library license limit line link list load local location lock login long lookup
machine magic main manager manual market master match matrix maximum member memory menu merge message method middle
minimum mobile model modify module money monitor month move name native nested network node normal note notice number
object offset online open option order origin output owner package page paper param parent parse part path pattern
payment pending person phone picture pipeline place plain player plugin point policy pool port position power prefix
prepare preview price primary print private process product profile program project property proxy public publish
python query queue quick random range rate read record recover reduce refresh region register release remote remove
rename render repeat replace report request require reserve reset resource response restore result return review right
role root route rule sample scale schedule schema scope screen script search second section select send sequence server
service session setting shape share shell short shutdown signal simple single size slice small socket software source
space special split stack stage standard start state static status step stop storage store stream string strong style
submit success suffix summary support switch symbol system table target task team template temporary test text theme
thread time title toggle tools topic total trace track traffic transfer transform translate tree trigger type under
union unique update upload user utility value variable vector version video view virtual visible volume warning watch
website weight width window word worker world write zone""".split()  # noqa: SIM905

_HEX, _B64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_NAMES = ["token", "api_key", "apikey", "secret", "client_secret", "auth_token", "access_token", "private_key", "password", "passwd", "pwd", "credential", "SECRET_KEY", "bearer", "access_key", "key"]
_PATHS = ["src/app.py", "config/prod.env", "settings.yaml", "deploy/main.tf", "src0", "src7", "web", "notes", "", ".env"]
_TEST_PATHS = ["tests/test_app.py", "docs/example.md", "package-lock.json", "go.sum", "yarn.lock", "fixtures/sample.json"]


def labelled_findings(n: int = 3000, seed: int = 17) -> list[tuple[str, str, str, str, int]]:
    r = random.Random(seed)
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    words = lambda k: [r.choice(WORDS) for _ in range(k)]
    blend = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve")) for _ in range(r.randint(2, 9)))
    prose = lambda: " ".join(r.choice((r.choice(WORDS), blend())) for _ in range(r.randint(0, 8)))
    out = []
    for i in range(n):
        path = r.choice(_PATHS)
        before, after = prose(), prose()
        q = r.choice(['"', "'", '"', ""])
        if i % 2:
            kind = r.randrange(7)
            name = r.choice(_NAMES)
            name = name.upper() if r.random() < 0.3 else name
            join = r.choice([" = ", "=", ": ", ":", " := ", "='", " "]) if q else r.choice([" = ", "=", ": "])
            value = [lambda: some(_HEX, r.choice([32, 40, 40, 64])), lambda: some(_B64, r.randint(20, 44)), lambda: base64.b64encode(r.randbytes(r.choice([24, 32, 48]))).decode(), lambda: r.choice(["AKIA", "ghp_", "sk-", "xoxb-", "glpat-"]) + some(_B64, r.randint(20, 36)), lambda: some(_B64 + "!@#%^&*", r.randint(10, 18)), lambda: "eyJ" + some(_B64, 24) + "." + some(_B64, 30) + "." + some(_B64, 27), lambda: some(_HEX.upper(), r.choice([32, 40, 64]))][kind]()
            if kind in (3, 5) and r.random() < 0.5:
                out.append((f"{before} ", value, f" {after}", path, 1))
            else:
                out.append((f"{before} {name}{join}{q}", value, f"{q} {after}", path, 1))
            continue
        kind = r.randrange(12)
        if kind == 0:
            found = (f"{before} {r.choice(['commit', 'sha', 'revision', 'merge', 'blob', 'parent'])}{r.choice([' ', ': '])}", some(_HEX, 40), f" {after}")
        elif kind == 1:
            found = (f"{before} {r.choice(['md5', 'sha256', 'checksum', 'etag', 'digest', 'integrity'])}{r.choice([': ', '=', '-'])}{q}", some(_HEX, r.choice([32, 64])), f"{q} {after}")
        elif kind == 2:
            u = some(_HEX, 32)
            found = (f"{before} {r.choice(['id', 'uuid', 'request', 'trace'])}{r.choice([' = ', ': ', ' '])}{q}", "-".join((u[:8], u[8:12], u[12:16], u[16:20], u[20:])), f"{q} {after}")
        elif kind == 3:
            found = (f"{before} ", r.choice([some("0123456789", r.randint(16, 20)), some("0123456789", 10) + "-" + some("0123456789", 8), ".".join(some("0123456789", 3) for _ in range(5))]), f" {after}")
        elif kind == 4:
            found = (f"{before} ", "/".join(words(r.randint(3, 6))) + r.choice([".py", ".js", "/v2", "_1", ".html"]), f" {after}")
        elif kind == 5:
            found = (f"{before} ", "".join(w.title() for w in words(r.randint(3, 5))) + some("0123456789", r.randint(1, 2)), f"() {after}")
        elif kind == 6:
            found = (f"{before} ", "_".join(words(r.randint(3, 5))) + "_" + some("0123456789", r.randint(1, 4)), f" {after}")
        elif kind == 7:
            found = (f"{before} {r.choice(_NAMES)}{r.choice([' = ', ': ', '='])}{q}", r.choice(["your_" + r.choice(WORDS) + "_here_123", "xxxxxxxxxxxxxxxxxxxx", "changeme1234567", "EXAMPLE_KEY_1234", "<" + r.choice(WORDS) + "_token_1>", "insert-your-key-here-0", "os.environ.get", "config." + r.choice(WORDS) + ".value1", "00000000000000000000", "1234567890123456", "process.env." + r.choice(WORDS).upper() + "_1"]), f"{q} {after}")
        elif kind == 8:
            found = (f"{before} ", blend() + blend() + r.choice(["", some("0123456789", 2)]) + blend(), f" {after}")
        elif kind == 9:
            found = (f"{before} data:image/png;base64,", base64.b64encode(r.randbytes(48)).decode(), f" {after}")
        elif kind == 10:
            found = (f"{before} {some('0123456789', 2)}@", "mail" + some("0123456789", 1) + "." + "".join(words(2)) + ".com", f" {after}")
        else:
            found = (f"{before} {r.choice(_NAMES)}{r.choice([' ', ': ', ' is '])}", blend() + blend() + some("0123456789", r.choice([0, 1])), f" {after}")
        out.append((*found, r.choice(_TEST_PATHS) if r.random() < 0.3 else path, 0))
    return out
