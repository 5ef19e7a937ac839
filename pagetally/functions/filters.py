"""Row predicates as Column builders. ``None`` means "no filter", so that nothing is planned for it."""
from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetally.functions import fixed_values as fixed


def all_of(*predicates: Column | None) -> Column | None:
    kept = [p for p in predicates if p is not None]
    return reduce(and_, kept) if kept else None


def any_of(*predicates: Column) -> Column:
    return reduce(or_, predicates)


def split_list(text: str) -> list[str]:
    """Parts of a comma list; blanks go, and a trailing comma gives no empty part."""
    return text.rstrip(",").replace(" ", "").split(",")


def device_class(user_agent: Column, device: str) -> Column | None:
    """Agents are stored as ``class:detail``."""
    if device == "all":
        return None
    if device == "nobot":
        return ~user_agent.startswith("bot")
    if device in ("desktop", "mobile", "bot"):
        return user_agent.startswith(device)
    return F.lit(False)


def raw_device_class(user_agent: Column, device: str) -> Column | None:
    """The same classes from an unprocessed browser user-agent text."""
    browser, handheld = user_agent.startswith("Mozilla"), user_agent.contains("Mobile")
    if device == "all":
        return None
    return {"desktop": browser & ~handheld, "mobile": handheld, "bot": ~browser}.get(device, F.lit(False))


def url_matches(url: Column, wanted: str) -> Column | None:
    """Prefix by default; ``…$`` exact; ``…?`` exact path with or without a query string. One trailing mark counts."""
    if wanted == "-":
        return None
    bare = wanted[:-1] if wanted.endswith(("$", "?")) else wanted
    schemes = ["https://"] + (["http://"] if wanted.startswith("localhost") else [])
    if wanted.endswith("$"):
        return any_of(*(url == s + bare for s in schemes))
    if wanted.endswith("?"):
        return any_of(*((url == s + bare) | url.startswith(s + bare + "?") for s in schemes))
    return any_of(*(url.startswith(s + bare) for s in schemes))


def host_matches(hostname: Column, wanted: str) -> Column | None:
    if wanted == "-":
        return None
    same = hostname == wanted.rstrip("$?").split("/")[0]
    return same | (hostname == "localhost") if wanted.startswith("localhost:") else same


def page_matches(url: Column, hostname: Column, wanted: str) -> Column | None:
    """Url filter of the scan: url and host of one page filter, or a comma list of hosts."""
    if wanted == "-":
        return None
    return (url_matches(url, wanted) & host_matches(hostname, wanted)) | hostname.isin(split_list(wanted))


def valid_weight(weight: Column) -> Column:
    return weight.isin(*fixed.VALID_WEIGHTS)


def valid_hostname(hostname: Column) -> Column:
    return F.coalesce(hostname.rlike(fixed.VALID_HOSTNAME), F.lit(False))


def equals(column: Column, wanted: str) -> Column | None:
    return None if wanted == "-" else column == wanted


def starts_with_any(column: Column, prefixes: str) -> Column | None:
    """The value starts with one of a comma list of prefixes."""
    if prefixes == "-":
        return None
    return any_of(*(column.startswith(part.strip()) for part in prefixes.split(",")))


def public_hosts(hostname: Column, suffixes: tuple[str, ...], readmit: str | None = None) -> Column:
    """Real sites: no empty name, address, local or excluded host. ``readmit`` overrides all of it."""
    kept = (hostname != "") & ~hostname.rlike(fixed.IPV4_HOSTNAME) & ~hostname.startswith("localhost")
    kept = kept & without_suffix(hostname, suffixes)
    return kept | (hostname == readmit) if readmit else kept


def without_suffix(column: Column, suffixes: tuple[str, ...]) -> Column:
    return all_of(*(~column.endswith(s) for s in suffixes))


def branch_preview(url: Column, owner: str, repo: str) -> Column:
    """Urls of an owner/repo branch preview host."""
    return url.like(f"https://%{repo}--{owner}{fixed.PREVIEW_INFIX}%/")


def strip_www(hostname: Column) -> Column:
    return F.regexp_replace(hostname, r"^www\.", "")


def strip_query(url: Column) -> Column:
    return F.regexp_replace(url, r"\?.*$", "")
