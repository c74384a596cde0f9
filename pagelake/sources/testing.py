"""A transport without a network, for tests of the live source."""


def fetch(url: str) -> tuple[int, str, str]:
    if "bad" in url:
        raise OSError("refused")
    return 200, "text/html", f"<p>{url}</p>"
