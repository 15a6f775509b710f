"""Classes of IPv4 addresses as integer ranges, of IPv6 addresses as ranges of their 32 hexadecimal digits."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import let

#: Ranges of each class.
PRIVATE = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
NOT_PRIVATE = ("192.0.0.9/32", "192.0.0.10/32")
SHARED = ("100.64.0.0/10",)
LOOPBACK, LINK_LOCAL, MULTICAST, RESERVED = ("127.0.0.0/8",), ("169.254.0.0/16",), ("224.0.0.0/4",), ("240.0.0.0/4",)
#: The same of IPv6.
PRIVATE_6 = ("::1/128", "::/128", "::ffff:0.0.0.0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10")
NOT_PRIVATE_6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
LOOPBACK_6, LINK_LOCAL_6, MULTICAST_6, UNSPECIFIED_6, MAPPED_6 = ("::1/128",), ("fe80::/10",), ("ff00::/8",), ("::/128",), ("::ffff:0.0.0.0/96",)
RESERVED_6 = ("::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9")

VALID = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"


def _range(block: str) -> tuple[int, int]:
    address, bits = block.split("/")
    low = sum(int(o) << s for o, s in zip(address.split("."), (24, 16, 8, 0), strict=True))
    return low, low + (1 << (32 - int(bits))) - 1


def is_valid(ip: Column) -> Column:
    """Whether the text is an IPv4 address (no leading zeros)."""
    return F.coalesce(ip.rlike(VALID), F.lit(False))


def number(ip: Column) -> Column:
    """The address as a number, null if the text is none."""
    octets = F.split(ip, r"\.")
    value = sum((F.element_at(octets, i + 1).try_cast("bigint") * F.lit(1 << s).cast("bigint") for i, s in enumerate((24, 16, 8, 0))), F.lit(0).cast("bigint"))
    return F.when(is_valid(ip), value)


def within(n: Column, blocks: tuple[str, ...]) -> Column:
    """Whether the number lies in one of the blocks."""
    return reduce(or_, (n.between(*_range(b)) for b in blocks))


_GROUPS = "[0-9a-f]{1,4}(:[0-9a-f]{1,4})*"
_WHOLE, _SHORT = r"^[0-9a-f]{1,4}(:[0-9a-f]{1,4}){7}\z", rf"^({_GROUPS})?::({_GROUPS})?\z"


def digits(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, null if the text is none; a zone (%...) is passed over, a tail may be written as IPv4."""
    text = F.regexp_replace(F.lower(ip), r"%[^%]+\z", "")
    tail = number(F.regexp_extract(text, r"([^:]*)\z", 1))
    last = F.concat_ws(":", *(F.lower(F.hex(x)) for x in (F.shiftright(tail, 16), tail.bitwiseAND(65535))))
    plain = F.when(~text.contains("."), text).when(tail.isNotNull(), F.concat(F.regexp_extract(text, r"^(.*:)", 1), last))

    def spread(t: Column) -> Column:
        halves = F.split(t, "::")
        groups = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
        padded = lambda i: F.array_join(F.transform(groups(i), lambda g: F.lpad(g, 4, "0")), "")
        missing = 8 - F.size(groups(0)) - F.size(groups(1))
        return F.when(t.rlike(_WHOLE) | (t.rlike(_SHORT) & (missing > 0)), F.concat(padded(0), F.repeat(F.lit("0000"), missing), padded(1)))

    return let(plain, spread)


def _range_6(block: str) -> tuple[str, str]:
    network = ipaddress.ip_network(block)
    return f"{int(network.network_address):032x}", f"{int(network.broadcast_address):032x}"


def within_6(h: Column, blocks: tuple[str, ...]) -> Column:
    """Whether the digits lie in one of the blocks."""
    return reduce(or_, (h.between(*_range_6(b)) for b in blocks))


def _told(ip: Column, four: Callable[[Column], Column], six: Callable[[Column], Column]) -> Column:
    """``four`` of an IPv4 address's number, ``six`` of an IPv6 address's digits, false for other text."""
    return F.coalesce(F.when(ip.contains(":"), let(digits(ip), six)).otherwise(four(number(ip))), F.lit(False))


def _mapped(h: Column) -> Column:
    """The number of the IPv4 address that the digits map, null if none."""
    return F.when(within_6(h, MAPPED_6), F.conv(F.substring(h, 25, 8), 16, 10).cast("bigint"))


def _private(n: Column) -> Column:
    return within(n, PRIVATE) & ~within(n, NOT_PRIVATE)


def _private_6(h: Column) -> Column:
    return F.coalesce(_private(_mapped(h)), within_6(h, PRIVATE_6) & ~within_6(h, NOT_PRIVATE_6))


def is_private(ip: Column) -> Column:
    """Private as the standard library of Python 3.13 has it; text that is no address is not private."""
    return _told(ip, _private, _private_6)


def is_global(ip: Column) -> Column:
    """Publicly routable: not private, nor shared as IPv4."""
    return _told(ip, lambda n: ~_private(n) & ~within(n, SHARED), lambda h: ~_private_6(h))


def is_loopback(ip: Column) -> Column:
    return _told(ip, lambda n: within(n, LOOPBACK), lambda h: F.coalesce(within(_mapped(h), LOOPBACK), within_6(h, LOOPBACK_6)))


def is_link_local(ip: Column) -> Column:
    return _told(ip, lambda n: within(n, LINK_LOCAL), lambda h: within_6(h, LINK_LOCAL_6))


def is_multicast(ip: Column) -> Column:
    return _told(ip, lambda n: within(n, MULTICAST), lambda h: within_6(h, MULTICAST_6))


def is_reserved(ip: Column) -> Column:
    return _told(ip, lambda n: within(n, RESERVED), lambda h: within_6(h, RESERVED_6))


def is_unspecified(ip: Column) -> Column:
    return _told(ip, lambda n: n == 0, lambda h: within_6(h, UNSPECIFIED_6))


def classify(ip: Column) -> Column:
    """Struct of the version and the class flags; null if the text is no address."""
    flags = (is_private, is_global, is_loopback, is_link_local, is_multicast, is_reserved, is_unspecified)
    version = F.when(is_valid(ip), 4).when(digits(ip).isNotNull(), 6)
    return F.when(version.isNotNull(), F.struct(version.alias("version"), *(f(ip).alias(f.__name__) for f in flags)))
