"""Invented prose for tests, and the generator of the labelled table of personal data.

``python tests/llm/tests_llm_util.py > specloom/llm/pii_labelled.txt`` makes the table anew.
"""

import random


def word(r: random.Random) -> str:
    return "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))


def prose(r: random.Random, words: int) -> str:
    out, n = [], 0
    while n < words:
        k = r.randint(3, 14)
        out.append(" ".join(word(r) for _ in range(k)).capitalize() + ".")
        n += k
    return " ".join(out)


def edited(r: random.Random, text: str, share: float) -> str:
    return " ".join(word(r) if r.random() < share else w for w in text.split())


def labelled_rows(rows: int, seed: int) -> list[str]:
    """Marked texts: personal data of every kind among words, and what looks like it but is none."""
    r = random.Random(seed)
    syllables = ["an", "er", "to", "lis", "men", "ka", "ro", "ti", "ü", "sé", "ña", "or", "the", "ing", "que", "da", "vo", "be", "sch", "ion", "st", "nd"]

    def some_word() -> str:
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        return r.choice([w, w, w, w, w.capitalize(), w.upper() if r.random() < 0.3 else w])

    name = lambda: "".join(r.choice(syllables[:8] + syllables[11:18]) for _ in range(r.randint(2, 4))).capitalize()

    def digits(a: int, b: int | None = None) -> str:
        return "".join(r.choice("0123456789") for _ in range(r.randint(a, b or a)))

    chars = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    hexes, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mixed = upper + upper.lower() + "0123456789"
    host = lambda: r.choice(["mail", "post", "mx", "inbox", "corp"]) + r.choice(["", digits(1)]) + "." + r.choice(["example", "test", "invalid", some_word().lower()]) + "." + r.choice(["com", "org", "net", "de"])
    user = lambda: r.choice([some_word() + "." + digits(1, 3), some_word().lower(), some_word() + "." + some_word().lower(), some_word() + "_" + some_word(), some_word() + digits(1, 3), some_word() + "-" + some_word() + "." + digits(2)])
    fill = lambda pattern: "".join(digits(1) if c == "d" else c for c in pattern)
    cue = lambda *words: r.choice(words) + r.choice([" ", ": ", " = ", " = \"", "=", " \"", ": \""])

    def phone() -> str:
        if r.random() < 0.5:
            return "[[PHONE " + fill(r.choice(["+d (ddd) ddd-dddd", "+dd (ddd) ddd-dddd", "+d ddd ddd-dddd"])) + "]]"
        return r.choice(["", "tel ", "Tel. ", "phone: ", "call "]) + "[[PHONE " + fill(r.choice(["(ddd) ddd-dddd", "ddd-ddd-dddd", "+dd dd dddd dddd", "+dd ddd ddd dd dd", "+dd d dd dd dd dd", "+dd ddd dddddd", "+ddddddddddd", "+dd-ddd-ddddddd", "0dd ddddddd", "0ddd-dddddd", "0ddd/ddddddd", "0d dd dd dd dd"])) + "]]"

    def secret() -> str:
        known = ["AKIA" + chars(upper + "0123456789", 16), "ghp_" + chars(mixed, 36), "sk-" + chars(mixed, 32), "eyJ" + chars(mixed, 17) + "." + "eyJ" + chars(mixed, 30) + "." + chars(mixed + "-_", 43), "AIza" + chars(mixed, 35)]
        if r.random() < 0.35:
            return r.choice(["", cue("key", "token", "Bearer", "secret")]) + "[[SECRET " + r.choice(known) + "]]"
        value = r.choice([chars(hexes, r.choice([32, 40, 40, 64])), chars(hexes, 40), chars(mixed, r.randint(20, 44))])
        return r.choice(["token = \"", "token = \"", "token = \"", cue("token", "api_key", "secret", "password", "apikey", "access_token", "key")]) + "[[SECRET " + value + "]]"

    def iban() -> str:
        tail = r.choice([digits(18), digits(20), digits(23), chars(upper, 4) + digits(14)])
        value = r.choice(["DE", "FR", "ES", "GB", "NL", "IT", "AT"]) + digits(2) + tail
        return r.choice(["", "IBAN ", "IBAN: ", "account "]) + "[[IBAN " + r.choice([value, " ".join(value[i : i + 4] for i in range(0, len(value), 4))]) + "]]"

    kinds = [
        lambda: "[[EMAIL " + user() + "@" + host() + "]]", lambda: "[[IP " + ".".join(str(r.randint(0, 255)) for _ in range(4)) + "]]", phone, phone, secret, secret, iban,
        lambda: "[[CARD " + r.choice([digits(16), digits(16), digits(16), digits(15), "-".join(digits(4) for _ in range(4)), " ".join(digits(4) for _ in range(4)), fill("dddd dddddd ddddd")]) + "]]",
        lambda: "[[IP " + r.choice([":".join(chars(hexes, 4) for _ in range(8)), "2001:db8::" + chars(hexes, 4), "fe80::" + ":".join(chars(hexes, r.randint(1, 4)) for _ in range(4)), ":".join(chars(hexes, r.randint(1, 4)) for _ in range(8))]) + "]]",
        lambda: "[[MAC " + r.choice([":", "-"]).join(chars(hexes, 2) for _ in range(6)) + "]]", lambda: r.choice(["", "SSN ", "ssn: "]) + "[[NATIONAL_ID " + fill("ddd-dd-dddd") + "]]",
        lambda: r.choice(["Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Madame"]) + r.choice([" ", ". ", " "]) + "[[PERSON " + r.choice([name(), name() + " " + name(), name() + " " + name()]) + "]] " + r.choice(["said", "und", "the", "has"]),
        lambda: "[[ADDRESS " + r.choice([digits(1, 4) + " " + name() + " " + r.choice(["Street", "St", "Avenue", "Road", "Lane", "Drive", "Boulevard"]), name() + " " + r.choice(["Straße", "Weg", "Platz", "Allee"]) + " " + digits(1, 3), digits(1, 3) + " Rue " + name(), "Calle " + name() + " " + digits(1, 3)]) + "]]",
    ]
    plain = [
        lambda: "version " + digits(1), lambda: digits(1) + "." + digits(1), lambda: ".".join(digits(1, 2) for _ in range(3)), lambda: fill("dddd-dd-dd"), lambda: fill("dd.dd.dddd"), lambda: fill("dd/dd/dddd"),
        lambda: digits(1, 9), lambda: digits(2) + ":" + digits(2), lambda: fill("dd:dd:dd"), lambda: "www." + host(), lambda: "http://" + host() + "/" + some_word(), lambda: some_word() + "." + some_word(), lambda: some_word() + "-" + some_word(),
        lambda: "(" + some_word() + ")", lambda: "@" + some_word(), lambda: some_word() + " = " + some_word(), lambda: "=", lambda: digits(1, 3) + "-" + digits(1, 3), lambda: some_word() + digits(1, 3), lambda: "+" + digits(1), lambda: "(" + digits(1, 4) + ")",
        lambda: some_word() + "/" + some_word(), lambda: digits(3) + "." + digits(3), lambda: some_word() + " = " + digits(1, 5), lambda: "v" + digits(1) + "." + digits(1), lambda: "n " + digits(4) + " " + digits(4), lambda: "no " + digits(4, 8), lambda: "order " + digits(6, 12),
        lambda: r.choice(["commit ", "sha256 ", "sha1: ", "md5 = ", "hash ", "checksum ", "rev ", "digest: ", ""]) + chars(hexes, r.choice([32, 40, 40, 64])), lambda: r.choice(["commit ", "rev "]) + chars(hexes, r.choice([7, 8, 10])),
        lambda: "-".join(chars(hexes, n) for n in (8, 4, 4, 4, 12)), lambda: r.choice(["ISBN ", "isbn "]) + r.choice([fill("ddd-d-dd-dddddd-d"), digits(13)]), lambda: chars(upper, r.randint(2, 4)) + "-" + digits(2, 5), lambda: chars(upper, 2) + digits(2, 6),
        lambda: digits(1, 3) + "," + digits(3) + "." + digits(2), lambda: digits(1, 3) + "%", lambda: name() + " " + name(), lambda: name() + " " + name() + " " + name(), lambda: digits(1, 4) + " " + name(), lambda: "the key " + some_word(), lambda: "a token of " + some_word(),
        lambda: "call " + some_word(), lambda: "page " + digits(1, 3), lambda: name() + " Street", lambda: "Dr of " + some_word(), lambda: digits(4) + " to " + digits(4), lambda: "password = " + some_word(), lambda: digits(1, 2) + ":" + digits(1, 3),
    ]
    junk = ["", "", "", "", ".", ",", "***", "$$$", "&&&", "###", "%%%", "!!", ";", ")", "?", "\""]
    out = []
    for _ in range(rows):
        parts = []
        for _ in range(r.randint(4, 12)):
            p = r.random()
            parts.append((r.choice(kinds)() if p < 0.22 else r.choice(plain)() if p < 0.5 else some_word()) + r.choice(junk))
        out.append(" ".join(parts))
    return out


if __name__ == "__main__":
    print("\n".join(labelled_rows(700, 11)))
