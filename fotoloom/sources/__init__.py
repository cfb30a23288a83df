"""Where rows come from: directories, frames, the catalog."""
