"""Messages between the tasks of a barrier stage.

Spark's own allGather takes a second a call, so it only tells where the first task listens and the key to it; from
then on messages go through that task.  A task that is lost ends the others, and Spark runs the stage again.
"""

from __future__ import annotations


class Together:
    def __init__(self):
        import os
        import secrets
        import socket
        from multiprocessing.connection import Client, Listener

        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        hosts = [x.address.rpartition(":")[0] or x.address for x in context.getTaskInfos()]
        self.n, self._clients, self._server = len(hosts), [], None
        if context.partitionId() == 0:
            key = secrets.token_hex(32)
            listener = Listener(("", 0), backlog=self.n, authkey=key.encode())
            context.allGather(f"{listener.address[1]} {key}")
            self._clients = [listener.accept() for _ in range(self.n - 1)]
            listener.close()
        else:
            port, key = next(m for m in context.allGather("") if m).split()
            self._server = Client((hosts[0].strip("[]"), int(port)), authkey=key.encode())
        for c in [self._server] if self._server is not None else self._clients:
            with socket.socket(fileno=os.dup(c.fileno())) as same:
                same.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)  # else small messages wait for each other

    def gather(self, message: bytes) -> list[bytes]:
        """The messages of all tasks, in the same order for each."""
        if self._server is not None:
            self._server.send_bytes(message)
            return [self._server.recv_bytes() for _ in range(self.n)]
        messages = [message, *(c.recv_bytes() for c in self._clients)]
        for c in self._clients:
            for m in messages:
                c.send_bytes(m)
        return messages
