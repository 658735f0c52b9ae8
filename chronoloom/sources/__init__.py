"""Where rows come from and are kept."""
