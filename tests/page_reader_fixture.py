"""A page reader over memory, for the paged source."""

ROWS = [
    {
        "permalink": f"p-{n}",
        "perihal": f"subject {n}",
        "tanggal_efektif": "01-02-2024",
        "status_dokumen": "Berlaku",
        "topik": None if n == 3 else [{"uuid": n % 4, "keterangan": f"Topik {n % 4}"}],
    }
    for n in range(23)
]


def read_page(page: int, limit: int) -> dict:
    total = -(-len(ROWS) // limit)
    return {
        "data": {"search_data": ROWS[(page - 1) * limit : page * limit]},
        "pagination": {"total_page": total},
    }
