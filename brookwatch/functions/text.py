"""Text transforms on names, URLs and payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .address import bind
from .names import qtype_name

# Fixed value: pattern of an acceptable DNS name.
DOMAIN_PATTERN = r"^[a-zA-Z0-9][-a-zA-Z0-9]{0,62}(\.[a-zA-Z0-9][-a-zA-Z0-9]{0,62})+\.?$"

# Alphabets of the model encodings; a character's code is its
# position plus 2.  Code 79 is unused in the URL alphabet.
DOMAIN_ALPHABET = "-_.0123456789abcdefghijklmnopqrstuvwxyz"
URL_ALPHABET = ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
                "!\"#$%&'()*+,-./" "\0" ";<=>?@[\\]^_`{|}~")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_domain(s="qname") -> Column:
    return _c(s).rlike(DOMAIN_PATTERN)


def chars(s) -> Column:
    """The characters of a text as an array."""
    return F.filter(F.split(_c(s), ""), lambda x: x != "")


def octets(s) -> Column:
    """The UTF-8 bytes of a text as an array of hex pairs."""
    return F.regexp_extract_all(F.hex(F.encode(_c(s), "UTF-8")), F.lit("(..)"), F.lit(1))


def escape_text(s) -> Column:
    """Drop double quotes and unnamed control characters, escape the rest."""
    out = F.regexp_replace(_c(s), r"[\x01-\x07\x0e-\x1f\"]", "")
    out = F.replace(out, F.lit("\\"), F.lit("\\\\"))
    for raw, mark in (("\n", "n"), ("\r", "r"), ("\b", "b"), ("\v", "v"), ("\t", "t"), ("\f", "f")):
        out = F.replace(out, F.lit(raw), F.lit("\\\\" + mark))
    return out


def percent_encode(s) -> Column:
    """Percent-encode every byte outside letters, digits and ``*@-_+./``."""
    keep = [f"{b:02X}" for b in range(256) if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "*@-_+./")]
    kept = F.str_to_map(F.lit(" ".join(f"{h}={chr(int(h, 16))}" for h in keep)), F.lit(" "), F.lit("="))
    return F.concat_ws("", F.transform(octets(s), lambda h: F.coalesce(
        F.try_element_at(kept, h), F.concat(F.lit("%"), h))))


def printable(s) -> Column:
    """Bytes outside 0x20..0x7e become dots; quote and backslash are escaped."""
    out = F.when(_c(s).rlike(r"[^\x00-\x7f]"), _dot_bytes(s)).otherwise(
        F.regexp_replace(_c(s), r"[^\x20-\x7e]", "."))
    return F.regexp_replace(out, r'(["\\])', r"\\$1")


def _dot_bytes(s) -> Column:
    return F.concat_ws("", F.transform(octets(s), lambda h: F.when(
        F.conv(h, 16, 10).cast("int").between(0x20, 0x7E),
        F.decode(F.unhex(h), "UTF-8")).otherwise(".")))


def clean_text(s) -> Column:
    """Replace text holding anything outside ASCII and CJK ideographs."""
    return F.when(_c(s).rlike(r"[^\x00-\x7f一-鿿]"), "abnormal character").otherwise(_c(s))


def hex_text(s) -> Column:
    return F.hex(F.encode(_c(s), "UTF-8"))


def app_context() -> Column:
    """``qname,qtype`` for DNS; URL, host, method, type, agent, cookie, code for HTTP."""
    http = [F.col(c) for c in ("http_url", "http_host", "http_method", "http_mime",
                               "http_user_agent", "http_cookie")]
    any_http = F.concat(*[F.coalesce(c, F.lit("")) for c in http]) != ""
    joined = F.concat_ws(",", escape_text(http[0]), escape_text(http[1]), *http[2:],
                         F.col("http_ret_code").cast("string"))
    dns = F.concat_ws(",", escape_text("qname"), qtype_name("qtype"))
    return F.when(any_http, joined).when(F.col("qname") != "", dns).otherwise("")


def app_proto() -> Column:
    return F.coalesce(F.nullif(F.col("pname"), F.lit("")), F.nullif(F.col("service_name"), F.lit("")), F.lit(""))


def sub_label(q="qname") -> Column:
    """First label, or empty where the name has no dot."""
    q = _c(q)
    return F.when(F.instr(q, ".") > 0, F.substring_index(q, ".", 1)).otherwise("")


def base_domain(q="qname") -> Column:
    """Last two labels (a trailing dot is kept); empty where there is no dot."""
    q = _c(q)
    return (F.when(F.instr(q, ".") == 0, "")
            .when(q.endswith("."), F.substring_index(q, ".", -3))
            .otherwise(F.substring_index(q, ".", -2)))


def top_label(q="qname") -> Column:
    """Last label, a trailing dot aside; empty where there is no dot."""
    bare = F.regexp_replace(_c(q), r"\.$", "")
    return F.when(F.instr(bare, ".") > 0, F.substring_index(bare, ".", -1)).otherwise("")


def char_entropy(s="qname") -> Column:
    """Shannon entropy (bits) of a text's bytes."""
    s = _c(s)
    seq = F.when(F.octet_length(s) == F.char_length(s), chars(s)).otherwise(octets(s))

    def total(q):
        n = F.size(q).cast("double")

        def term(ch):
            return bind(F.size(F.filter(q, lambda x: x == ch)) / n, lambda p: -F.log2(p) * p)

        return F.aggregate(F.transform(F.array_sort(F.array_distinct(q)), term), F.lit(0.0), lambda acc, x: acc + x)

    return F.when(F.length(s) > 0, bind(seq, total)).otherwise(0.0)


def _encode(s, alphabet: str, width: int) -> Column:
    seq = F.slice(chars(s), 1, width)
    at = F.transform(seq, lambda ch: F.instr(F.lit(alphabet), ch))
    codes = F.transform(at, lambda i: F.when(i > 0, i + 1).otherwise(1))
    return F.concat(codes, F.array_repeat(F.lit(0), F.lit(width) - F.size(codes)))


def encode_domain(s="qname") -> Column:
    """128 integers: 2..40 for known characters, 1 for others, 0 padding."""
    return _encode(s, DOMAIN_ALPHABET, 128)


def encode_url(s="http_url") -> Column:
    """256 integers: 2..95 for known characters, 1 for others, 0 padding."""
    return _encode(s, URL_ALPHABET, 256)
