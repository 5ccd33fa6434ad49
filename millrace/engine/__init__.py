"""Session, catalogue, SQL gate, paging and result encoding."""
