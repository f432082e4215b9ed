"""Character scanners that read the text rules in words, for expected values."""

import unicodedata


def is_letter(c):
    """A letter or a number that is no decimal digit."""
    return c.isalnum() and unicodedata.category(c) != "Nd"


def skip_blanks(text, at):
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def counted_units(text):
    """Units between blanks in which some character is a letter or a number."""
    units, start = [], None
    for at, c in enumerate(text + " "):
        if c.isspace():
            if start is not None and any(map(str.isalnum, text[start:at])):
                units.append(text[start:at])
            start = None
        elif start is None:
            start = at
    return units


def hyphen_gap(text, at):
    """End of the blanks after a hyphen that follows a letter, or None without such a hyphen."""
    if at and text[at] in "-­" and is_letter(text[at - 1]):
        return skip_blanks(text, at + 1)
    return None


def rejoined(text):
    """Word halves across a line end put together."""
    out, at = [], 0
    while at < len(text):
        gap = hyphen_gap(text, at)
        if gap is not None and gap < len(text) and "\n" in text[at:gap] and is_letter(text[gap]):
            at = gap
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def hangs(text):
    """Ends in a hyphen after a letter, blanks aside."""
    tail = len(text.rstrip())
    return tail > 0 and hyphen_gap(text, tail - 1) is not None


def opens_with_letter(text):
    at = skip_blanks(text, 0)
    return at < len(text) and is_letter(text[at])


def unlabelled(text):
    """Without the label: the word Map, blanks, digits, a full stop, blanks."""
    at = skip_blanks(text, 3)
    end = at
    while end < len(text) and unicodedata.category(text[end]) == "Nd":
        end += 1
    labelled = text.startswith("Map") and 3 < at < end < len(text) and text[end] == "."
    return text[skip_blanks(text, end + 1) :] if labelled else text
