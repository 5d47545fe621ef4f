"""What the host has: its tag, compilers and their include folders, and files of configuration.

The probes run a compiler that is given or found on the path; none of them is
needed to read sources.
"""

from __future__ import annotations

import json
import os
import platform
import re
import shutil
import subprocess
from pathlib import Path

# Host tags of prebuilt toolchains.
HOST_TAGS = {"Linux": "linux-x86_64", "Darwin": "darwin-x86_64", "Windows": "windows-x86_64"}


def host_tag(ndk_root: str = "", system: str | None = None) -> str:
    """The folder of prebuilt tools for this host; if the toolchain lacks it, the first one that it has."""
    tag = HOST_TAGS.get(system or platform.system(), HOST_TAGS["Linux"])
    folder = Path(ndk_root, "toolchains/llvm/prebuilt")
    if ndk_root and folder.is_dir() and not (folder / tag).is_dir():
        return next((x.name for x in sorted(folder.iterdir()) if x.is_dir()), tag)
    return tag


def version_key(name: str) -> tuple[int, ...]:
    """The numbers of a name, to sort versions by."""
    return tuple(int(x) for x in re.findall(r"\d+", name))


def newest(names: list[str]) -> list[str]:
    """Names of versions, the newest first."""
    return sorted(names, key=lambda name: (version_key(name), name), reverse=True)


def _ask(arguments: list[str]) -> tuple[str, str]:
    try:
        done = subprocess.run(arguments, stdin=subprocess.DEVNULL, capture_output=True, text=True, timeout=20, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return "", ""
    return (done.stdout, done.stderr) if done.returncode == 0 else ("", "")


def find_compiler(names: tuple[str, ...] = ("clang++", "clang")) -> str | None:
    return next((found for name in names if (found := shutil.which(name))), None)


def resource_include(compiler: str | None, roots: tuple[str, ...] = ("/usr/lib/clang", "/usr/local/lib/clang")) -> str | None:
    """The compiler's own include folder: as it says, else of the newest version below ``roots``."""
    if compiler:
        folder = os.path.join(_ask([compiler, "-print-resource-dir"])[0].strip(), "include")
        if os.path.isabs(folder) and os.path.isdir(folder):
            return folder
    for root in roots:
        if os.path.isdir(root):
            for name in newest(os.listdir(root)):
                if os.path.isdir(folder := os.path.join(root, name, "include")):
                    return folder
    return None


def search_folders(compiler: str) -> list[str]:
    """The folders a compiler looks for includes in, in its order, each once."""
    said = _ask([compiler, "-v", "-x", "c++", "-E", "-"])[1]
    listed = re.search(r"#include <\.\.\.> search starts here:\n(.*?)End of search list", said, re.S)
    lines = [x.strip().removesuffix(" (framework directory)") for x in listed[1].splitlines()] if listed else []
    return list(dict.fromkeys(os.path.normpath(x) for x in lines if os.path.isdir(x)))


def system_includes(compiler: str | None = None, roots: tuple[str, ...] = ("/usr/lib/clang", "/usr/local/lib/clang")) -> list[str]:
    """Folders for system includes: what the compiler searches, then its own."""
    compiler = compiler or find_compiler()
    found = search_folders(compiler) if compiler else []
    own = resource_include(compiler, roots)
    return list(dict.fromkeys([*found, *([own] if own else [])]))


def read_json(path: str) -> dict:
    """A configuration document; a missing or empty path is an empty one."""
    if not path or not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no object")
    return found


def write_json(value, path: str | None, dry: bool = False) -> str:
    """``value`` as indented JSON, written to ``path`` unless it is a dry run or there is no path; the text."""
    text = json.dumps(value, indent=2) + "\n"
    if path and not dry:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
    return text


def listing(values: list[str], as_json: bool = False) -> str:
    """Values one to a line, or as a JSON array."""
    return json.dumps(values) if as_json else "\n".join(values)


def preview(values: list, most: int = 5) -> list:
    return values[:most]
