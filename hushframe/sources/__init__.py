"""Readers and writers for documents, files, chats, streams and vaults."""
