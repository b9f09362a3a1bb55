import base64
import gzip

from ledgerlens.llm import secrets


def test_every_copy_of_an_encoded_secret_is_found():
    plain = b"x token=abcdef123?>~ y>>>"
    std, url = base64.b64encode(plain).decode(), base64.urlsafe_b64encode(plain).decode()
    packed = base64.b64encode(gzip.compress(plain)).decode()
    assert std != url
    for a, b in ((std, std), (std, url), (std, packed), (packed, packed)):
        t = f"one {a} two {b} end"
        found = [(s, e) for k, s, e in secrets.find(t)[1] if k == "assign"]
        first, second = t.index(a), t.index(" two ") + 5
        assert any(first <= s < e <= first + len(a) for s, e in found)
        assert any(second <= s < e <= second + len(b) for s, e in found)
        assert secrets.redact(t).count("[secret]") == 2
