"""Protocol, query-type, port-list and flag names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocol names by number, from 0.
PROTOCOLS = [
    "HOPOPT", "ICMP", "IGMP", "GGP", "IP", "ST", "TCP", "CBT", "EGP", "IGP",
    "BBN-RCC-MON", "NVP-II", "PUP", "ARGUS", "EMCON", "XNET", "CHAOS", "UDP", "MUX", "DCN-MEAS",
    "HMP", "PRM", "XNS-IDP", "TRUNK-1", "TRUNK-2", "LEAF-1", "LEAF-2", "RDP", "IRTP", "ISO-TP4",
    "NETBLT", "MFE-NSP", "MERIT-INP", "SEP", "3PC", "IDPR", "XTP", "DDP", "IDPR-CMTP", "TP++",
    "IL", "IPV6", "SDRP", "IPV6-ROUTE", "IPV6-FRAG", "IDRP", "RSVP", "GRE", "MHRP", "BNA",
    "ESP", "AH", "I-NLSP", "SWIPE", "NARP", "MOBILE", "TLSP", "SKIP", "IPV6-ICMP", "IPV6-NONXT",
    "IPV6-OPTS", "HOST", "CFTP", "NET", "SAT-EXPAK", "KRYPTOLAN", "RVD", "IPPC", "FS", "SAT-MON",
    "VISA", "IPCV", "CPNX", "CPHB", "WSN", "PVP", "BR-SAT-MON", "SUN-ND", "WB-MON", "WB-EXPAK",
    "ISO-IP", "VMTP", "SECURE-VMTP", "VINES", "TTP", "NSFNET-IGP", "DGP", "TCF", "EIGRP", "OSPFIGP",
    "SPRITE-RPC", "LARP", "MTP", "AX.25", "IPIP", "MICP", "SCC-SP", "ETHERIP", "ENCAP", "APES",
    "GMTP", "IFMP", "PNNI", "PIM", "ARIS", "SCPS", "QNX", "A/N", "IPCOMP", "SNP",
    "COMPAQ-PEER", "IPX-IN-IP", "VRRP", "PGM", "0HOP", "L2TP", "DDX", "IATP", "STP", "SRP",
    "UTI", "SMP", "SM", "PTP", "ISIS", "FIRE", "CRTP", "CRUDP", "SSCOPMCE", "IPLT",
    "SPS", "PIPE", "SCTP",
]

# DNS query-type names.
QTYPES = {
    1: "A", 2: "CS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 17: "RP", 18: "AFSDB",
    24: "SIG", 25: "KEY", 28: "AAAA", 29: "SOC", 33: "SRV", 35: "NAPTR", 37: "CERT", 39: "DNAME",
    42: "APL", 43: "DS", 44: "SSHFP", 45: "IPSECKEY", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY",
    49: "DHCID", 50: "NSEC3", 51: "NSEC3PARAM", 55: "HIP", 99: "SPF", 249: "TKEY", 250: "TSIG",
    32768: "TA", 32769: "DLV",
}

# UDP ports accepted as service ports.
UDP_SERVICE_PORTS = [
    7, 53, 80, 111, 123, 137, 161, 162, 177, 389, 427, 443, 500, 514, 520, 623, 626, 1194, 1604,
    2049, 2302, 3283, 3784, 5351, 5353, 5683, 6481, 8767, 9987, 10080, 11211, 17185, 26000, 27910,
    64738,
]

# Names of the URL attack classes, by number.
URL_ATTACKS = {1: "SQL_INJECT", 2: "XSS", 3: "RESO_EXPLORE", 4: "VISIT_ADMIN", 5: "PULL_DB",
               6: "CMD_EXEC", 7: "CODE_EXEC", 8: "XML_ENTITY"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def proto_name(p="prot") -> Column:
    p = _c(p).cast("int")
    # one literal split into the name array, folded to a constant by Catalyst
    known = F.split(F.lit(" ".join(PROTOCOLS)), " ")
    return F.coalesce(F.get(known, p), F.concat(F.lit("PROTO_"), p.cast("string")))


def proto_is(name: str, p="prot") -> Column:
    """Whether a protocol number carries a printed name."""
    if name in PROTOCOLS:
        return _c(p) == PROTOCOLS.index(name)
    number = name.removeprefix("PROTO_")
    if number != name and number.isdigit() and int(number) >= len(PROTOCOLS):
        return _c(p) == int(number)
    return F.lit(False)


def proto_number(name: str) -> int:
    """Number of a protocol name, or of a number written as text."""
    return int(name) if name.isdigit() else PROTOCOLS.index(name.upper())


def qtype_name(q="qtype") -> Column:
    q = _c(q).cast("int")
    known = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in QTYPES.items())))
    return F.coalesce(F.try_element_at(known, q.cast("string")),
                      F.concat(F.lit("QTYPE_"), q.cast("string")))


def flags_str(flags="tcp_flags") -> Column:
    """``UAPRSF`` with dots for unset bits; hex text above 63."""
    f = _c(flags)
    marks = [F.when(f.bitwiseAND(F.lit(bit)) != 0, mark).otherwise(".")
             for mark, bit in (("U", 32), ("A", 16), ("P", 8), ("R", 4), ("S", 2), ("F", 1))]
    return F.when(f > 63, F.concat(F.lit("0x"), F.lower(F.hex(f)))).otherwise(F.concat(*marks))


FLAG_BITS = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16, "U": 32, "X": 63}


def flag_mask(letters: str) -> int:
    mask = 0
    for ch in letters.upper():
        mask |= FLAG_BITS[ch]
    return mask


def icmp_type(dport="dstport") -> Column:
    return F.call_function("shiftright", _c(dport), F.lit(8))


def icmp_code(dport="dstport") -> Column:
    return _c(dport).bitwiseAND(F.lit(255))
