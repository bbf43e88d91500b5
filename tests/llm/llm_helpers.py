import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
