"""Dataset URLs: checked, then left to Hadoop's filesystems, which know hdfs with its name nodes, object stores and files."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urlparse


def checked(urls: str | Sequence[str]) -> list[str]:
    """One or several URLs of one scheme and host, without slashes at the end. A plain absolute path counts as file."""
    if isinstance(urls, str):
        urls = [urls]
    if not isinstance(urls, (list, tuple)) or not urls:
        raise ValueError("a URL or a list of them is needed")
    out = []
    for u in urls:
        if not isinstance(u, str) or not u:
            raise ValueError(f"{u!r} is no URL")
        u = u.rstrip("/")
        if not urlparse(u).scheme:
            if not u.startswith("/"):
                raise ValueError(f"{u} has no scheme and is no absolute path")
            u = f"file://{u}"
        out.append(u)
    places = {urlparse(u)[:2] for u in out}
    if len(places) > 1:
        raise ValueError(f"URLs must have one scheme and host: {sorted(places)}")
    return out
