"""Secrets and look-alikes that the field isn't fitted on: other cues, other services, other layouts."""

import base64
import random
import string
import uuid

CODE = string.ascii_letters + string.digits


def secrets_and_text(rng: random.Random) -> tuple[str, str]:
    """(the secret, a line's middle that has it)."""
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    value = pick(CODE, rng.randrange(18, 36))
    b64 = base64.b64encode(rng.randbytes(48)).decode()
    body = " ".join(base64.b64encode(rng.randbytes(48)).decode() for _ in range(3))
    cases = [
        (value, f"passcode: {value}"), (value, f"DB_PASS={value}"), (value, f"x-auth-key: {value}"), (value, f"the signing key is {value}"), (value, f'"pwd" : "{value}",'),
        (value, f"ftp://backup:{value}@files.example.org/daily"), (value, f"mongodb://root:{value}@db.example.net:27017/admin"), (b64, f"AccountKey={b64}"), (value, f"client credential {value}"),
        (f"npm_{pick(CODE, 36)}",) * 2, (f"glpat-{pick(CODE, 20)}",) * 2, (f"hf_{pick(CODE, 34)}",) * 2, (f"SG.{pick(CODE, 22)}.{pick(CODE, 43)}",) * 2,
        (body, f"-----BEGIN ENCRYPTED PRIVATE KEY----- {body} -----END ENCRYPTED PRIVATE KEY-----"), (value, f"Authorization: Bearer {value}"), (value, f"set AUTH_KEY {value}"), (value, f"passphrase = '{value}'"),
        (value, f"my wifi key is {value}."), (value, f"login with key={value};"), (value, f"credentials: {value}"),
    ]
    return rng.choice(cases)


def look_alike(rng: random.Random) -> str:
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hexes, low = "0123456789abcdef", string.ascii_lowercase
    return rng.choice([
        f"trace {uuid.UUID(int=rng.getrandbits(128))}", str(uuid.UUID(int=rng.getrandbits(128))), f"etag {pick(hexes, 32)[:30]}", f"git checkout {pick(hexes, 7)}", f"digest sha512:{pick(hexes, 30)}", ":".join(pick(hexes, 4) for _ in range(8)),
        f"{pick(low, 6)}_{pick(low, 5)}@{pick(low, 8)}.example.org", f"+{pick(string.digits, 2)} {pick(string.digits, 4)} {pick(string.digits, 6)}", ":".join(pick(hexes, 2) for _ in range(6)), f"20{pick(string.digits, 2)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}T10:2{rng.randrange(9)}:00Z",
        f"![x](data:image/jpeg;base64,{pick(CODE, 60)}{pick(CODE + '+/', 40)})", f"v{rng.randrange(9)}.{rng.randrange(99)}.{rng.randrange(99)}-rc.1", f"https://news.example.com/2024/05/{pick(low, 8)}-{pick(low, 7)}-{pick(low, 9)}", f"C:/Users/{pick(low, 6)}/Downloads/{pick(low, 9)}.zip",
        f"/var/log/{pick(low, 6)}/{pick(low, 8)}.{pick(string.digits, 6)}.log", f"max_{pick(low, 6)}_{pick(low, 8)}_count", f"#{pick(hexes, 6)}", f"doi:10.{pick(string.digits, 4)}/{pick(low, 5)}.{pick(string.digits, 5)}", f"{pick(string.digits, 3)}.{pick(string.digits, 2)}.{pick(string.digits, 3)}.{pick(string.digits, 2)}###",
        f"-----BEGIN PUBLIC KEY----- {base64.b64encode(rng.randbytes(48)).decode()} -----END PUBLIC KEY-----", "the key to a good life", "a secret garden", "he lost his pass", f"invoice {pick(string.digits, 10)}", f"ISBN 978-{pick(string.digits, 10)}", f"{pick(string.ascii_uppercase, 3)}-{pick(string.digits, 5)}", f"order id: {pick(string.digits, 14)}",
    ])
