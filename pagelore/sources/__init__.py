"""Reading and writing: page tables, JSON documents, binary files, line output."""
