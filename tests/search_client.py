"""A search client for the tests of the batch source."""


def search(query, most):
    if query == "fails":
        raise OSError("down")
    return [{"entry_id": f"http://x/abs/{query}{i}v1", "title": f"{query} {i}", "authors": ["A"]} for i in range(min(most, 2))]
