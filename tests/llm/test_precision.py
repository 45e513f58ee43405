"""Sentences with their exact results: what must be found, and what looks like it and must not be."""

import pytest

from lodestar.llm import licenses, secrets

NOTHING = """See the Python documentation.|under the artistic direction of the founder|provided by the MIT Media Lab|published by Ruby Press|under boost pressure|The PHP license plate
see the Ruby tutorial|under Apache leadership|distributed by PHP developers|published under the MIT Press imprint|available under the BSD kernel|governed by common public opinion|see the open database of plants
under responsible AI principles|released under Python supervision|see the MIT website|subject to public review|a driving license exam|see the artistic license plates|provided by Apache helicopters|under OpenSSL maintainers
covered by the Boston Globe|see under Ruby|released by Mozilla Public Affairs"""
FOUND = {
    "Released under MIT.": "mit", "licensed under Ruby": "ruby", "see the PHP license": "php-3.01", "Licensed under the Boost Software License": "boost-1.0", "released under the Python license": "python-2.0",
    "License: MIT": "mit", "SPDX-License-Identifier: Artistic": "artistic", "available under the Artistic License 2.0": "artistic-2.0", "governed by the GNU GPL": "gpl", "covered by the BSD license": "bsd",
    "under the terms of the MPL 2.0": "mpl-2.0", "see the open font license": "ofl-1.1", "You may not use this file except in compliance with the License.": "apache-2.0",
    "The origin of this software must not be misrepresented;": "zlib", "You should have received a copy of the GNU Affero General Public License": "agpl", "available under the ISC": "isc",
}


@pytest.mark.parametrize("text", [t for line in NOTHING.splitlines() for t in line.split("|")])
def test_no_license(text):
    assert [d.label for d in licenses.scan(f"We write that {text} was here.")[2]] == []


@pytest.mark.parametrize("text", sorted(FOUND))
def test_license(text):
    assert [d.label for d in licenses.scan(f"Note. {text}")[2]] == [FOUND[text]]


#: A text, and what the lexer adds to the base spans.
NAMES = [
    ("author: JohnSmith1987Writer", []), ('authority = "Kyoto2024Prefecture"', []), ("authored_by = 'Mika2024TanakaPress'", []), ("tokenizer_name = 'Byte50kVocabFile'", []), ("compass_heading = 'NorthEast45Degrees'", []),
    ("auth: Zk3Qm9Lp7Rt4Vb8", ["Zk3Qm9Lp7Rt4Vb8"]), ('auth_key = "Zk3Qm9Lp7Rt4Vb8"', ["Zk3Qm9Lp7Rt4Vb8"]), ('oauth = "Zk3Qm9Lp7Rt4Vb8"', ["Zk3Qm9Lp7Rt4Vb8"]), ('authToken2 = f("x")', []),
    ('private_key =\n    "Zk3Qm9Lp7Rt4Vb8"', ["Zk3Qm9Lp7Rt4Vb8"]), ('credential = (\n  "Zk3Qm9Lp7"\n  "Rt4Vb8Nc1"\n)', ["Zk3Qm9Lp7", "Rt4Vb8Nc1"]), ("<credential>Zk3Qm9Lp7Rt4Vb8</credential>", ["Zk3Qm9Lp7Rt4Vb8"]),
    ("<title>Zk3Qm9Lp7Rt4Vb8</title>", []), ('conf.set("credential", "Zk3Qm9Lp7Rt4Vb8")', ["Zk3Qm9Lp7Rt4Vb8"]), ('setPrivateKey("Zk3Qm9Lp7Rt4Vb8")', ["Zk3Qm9Lp7Rt4Vb8"]), ('conf.set("colour", "Zk3Qm9Lp7Rt4Vb8")', []),
    ("https://mika:Zk3Qm9Lp7Rt4Vb8@example.org/x", ["Zk3Qm9Lp7Rt4Vb8"]), ("passphrase = 'correct Horse battery 9 staple'", ["correct Horse battery 9 staple"]), ("credential = 'NoneZk3Qm9trueLp7Rt4'", ["NoneZk3Qm9trueLp7Rt4"]),
    ("credential = 'your-credential-here'", []), ("setenv CREDENTIAL Zk3Qm9Lp7Rt4Vb8", ["Zk3Qm9Lp7Rt4Vb8"]), ("credential = None", []), ("credential = 'changeme'", []),
]


@pytest.mark.parametrize("text, found", NAMES)
def test_names(text, found):
    assert [text[a:b] for a, b, _, _ in secrets.scan(text)[1]] == found


def test_randomness_is_at_most_one():
    assert secrets.randomness("aB3$" * 20 + "xyzXYZ019!?") <= 1.0
