"""Where rows come from: tables, source trees, logs and saved runs."""
