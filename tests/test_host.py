import json
import os
import stat

import pytest

from symgraph import compdb, host


@pytest.fixture
def compiler(tmp_path):
    """A script that answers like a compiler."""
    for folder in ("res/include", "inc/a", "inc/b"):
        (tmp_path / folder).mkdir(parents=True)
    script = tmp_path / "clang++"
    script.write_text(f"""#!/bin/sh
if [ "$1" = -print-resource-dir ]; then echo {tmp_path}/res; exit 0; fi
cat >&2 <<X
#include "..." search starts here:
#include <...> search starts here:
 {tmp_path}/inc/a
 {tmp_path}/inc/b
 {tmp_path}/inc/a
 {tmp_path}/none
End of search list.
X
""")
    script.chmod(script.stat().st_mode | stat.S_IXUSR)
    return str(script)


def test_a_compiler_is_asked(compiler, tmp_path):
    assert host.search_folders(compiler) == [f"{tmp_path}/inc/a", f"{tmp_path}/inc/b"]
    assert host.resource_include(compiler, ()) == f"{tmp_path}/res/include"
    assert host.system_includes(compiler, ()) == [f"{tmp_path}/inc/a", f"{tmp_path}/inc/b", f"{tmp_path}/res/include"]
    assert host.search_folders(str(tmp_path / "none")) == [] and host.resource_include(str(tmp_path / "none"), ()) is None


def test_the_newest_version_by_numbers(tmp_path):
    assert host.newest(["9.0.1", "14", "14.0.6", "3.9", "10.1"]) == ["14.0.6", "14", "10.1", "9.0.1", "3.9"]
    for name in ("9", "14.0.6/include", "10/include"):
        (tmp_path / name).mkdir(parents=True)
    assert host.resource_include(None, (str(tmp_path / "x"), str(tmp_path))) == f"{tmp_path}/14.0.6/include"


def test_host_tag(tmp_path):
    assert host.host_tag(system="Darwin") == "darwin-x86_64" and host.host_tag(system="Plan9") == "linux-x86_64"
    os.makedirs(tmp_path / "toolchains/llvm/prebuilt/other")
    assert host.host_tag(str(tmp_path), "Linux") == "other"
    os.makedirs(tmp_path / "toolchains/llvm/prebuilt/linux-x86_64")
    assert host.host_tag(str(tmp_path), "Linux") == "linux-x86_64"


def test_documents(tmp_path):
    path = str(tmp_path / "d/x.json")
    assert host.read_json(path) == {} and host.read_json("") == {}
    assert json.loads(host.write_json({"a": [1]}, path, dry=True)) == {"a": [1]} and not os.path.exists(path)
    host.write_json({"a": [1]}, path)
    assert host.read_json(path) == {"a": [1]}
    host.write_json([1], path)
    with pytest.raises(ValueError):
        host.read_json(path)
    assert host.listing(["a", "b"]) == "a\nb" and host.listing(["a"], True) == '["a"]' and host.preview(list(range(9))) == [0, 1, 2, 3, 4]


def test_folders_that_exist_and_the_second_library():
    config = {"ndk_root": "/n", "target_arch": "x86_64", "api_level": 21}
    base = "/n/toolchains/llvm/prebuilt/linux-x86_64/sysroot/usr/include"
    assert [x for x in compdb.build_arguments(config, exists=lambda p: p == base or p.startswith("/n/sources")) if x.startswith("/")] == [base, "/n/sources/cxx-stl/llvm-libc++/include"]
    assert "-isystem" not in compdb.build_arguments(config, exists=lambda p: False)
    assert len(compdb.summary(config).splitlines()) == 7
