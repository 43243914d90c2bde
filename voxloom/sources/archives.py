"""Archives of audio that are fetched and unpacked once."""

from __future__ import annotations

import os
import shutil
import tarfile
import urllib.request
import uuid
import zipfile
from pathlib import Path


def fetched(address: str, cache: str) -> Path:
    """The archive at an address or path, copied to a folder; one that is there already isn't fetched again."""
    target = Path(cache) / address.rstrip("/").rsplit("/", 1)[-1]
    if target.is_file():
        return target
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f"{target.name}.{uuid.uuid4().hex}")
    with urllib.request.urlopen(address if "://" in address else Path(address).resolve().as_uri()) as source, part.open("wb") as out:
        shutil.copyfileobj(source, out, 1 << 20)
    os.replace(part, target)
    return target


def unpacked(archive: Path, target: str) -> bool:
    """Unpack a TAR (of any compression) or ZIP archive to ``target``; False if that is there already. A single folder on top is
    left out. Members that would land outside are an error, and a folder appears whole or not at all."""
    place = Path(target)
    if place.exists():
        return False
    part = place.with_name(f"{place.name}.{uuid.uuid4().hex}")
    part.mkdir(parents=True)
    try:
        if zipfile.is_zipfile(archive):
            with zipfile.ZipFile(archive) as members:
                if any(os.path.isabs(n) or ".." in Path(n).parts for n in members.namelist()):
                    raise ValueError(f"{archive} has members outside of its folder")
                members.extractall(part)
        else:
            with tarfile.open(archive) as members:
                members.extractall(part, filter="data")
        top = list(part.iterdir())
        (top[0] if len(top) == 1 and top[0].is_dir() else part).rename(place)
    finally:
        shutil.rmtree(part, ignore_errors=True)
    return True
